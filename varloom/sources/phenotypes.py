"""Phenotype tables: quoted separated text of any layout, each file with a header of its own, as rows of known fields.

Cells are split by Spark's CSV reader, so that a quoted cell may hold separators, quotes and line ends. The header of a file is the best scored of its
first parsed rows; everything about headers is a row a file, joined with that file's rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names under which a table may call a field, in lower case and without anything but letters and digits.
ALIASES = {
    "individual_id": ("individualid", "subjectid", "patientid", "caseid", "studyid", "participantid", "individual", "subject", "patient", "case"),
    "sample_ids": ("sampleid", "sampleids", "vcfsample", "vcfsampleid", "sequencingsample", "specimenid", "sample", "samples"),
    "sex_at_birth": ("sexatbirth", "birthsex", "sex", "gender"),
    "age_at_evaluation": ("ageatevaluation", "ageatassessment", "currentage", "age"),
    "age_at_evaluation_unit": ("ageatevaluationunit", "ageunit", "ageunits"),
    "age_at_onset": ("ageatonset", "onsetage", "ageofdiseaseonset"),
    "age_at_onset_unit": ("ageatonsetunit", "onsetageunit"),
    "reported_race": ("reportedrace", "selfreportedrace", "race"),
    "reported_ethnicity": ("reportedethnicity", "selfreportedethnicity", "ethnicity"),
    "phenotype_summary": ("phenotypesummary", "clinicalsummary", "clinicalphenotype", "phenotype", "summary"),
    "present_features": ("presentfeatures", "positivefeatures", "clinicalfeatures", "featurespresent", "phenotypespresent"),
    "absent_features": ("absentfeatures", "negativefeatures", "pertinentnegatives", "featuresabsent", "phenotypesabsent"),
    "current_diagnosis": ("currentdiagnosis", "workingdiagnosis", "diagnosis", "diagnoses"),
    "notes": ("notes", "comments", "comment"),
    "source_date": ("sourcedate", "phenotypedate", "evaluationdate", "assessmentdate"),
}
#: A header is one of the first so many rows. Tables have at most so many columns; a wider row is an error.
LOOK_AT, COLUMNS = 20, 256
SEPARATORS = (",", "\t", ";")


@dataclass(frozen=True)
class PhenotypeTable:
    """headers: file, header_row, columns (different names), mapping (field -> column). rows: file, row_no (from 1, blank rows don't count), the fields (null if absent or blank), custom (map of other filled columns)."""

    headers: DataFrame
    rows: DataFrame

    def duplicates(self, key: str = "individual_id") -> DataFrame:
        """file, the key and row_nos: ids that a file has more than once, with their rows in order."""
        out = self.rows.filter(F.col(key).isNotNull()).groupBy("file", key).agg(F.array_sort(F.collect_list("row_no")).alias("row_nos"))
        return out.filter(F.size("row_nos") > 1)


def separator_of(spark: SparkSession, path: str) -> str:
    """The separator that most of the first lines have equally often outside of quotes; the comma if none does."""
    lines = [r["value"] for r in spark.read.text(path).limit(LOOK_AT).collect()]
    best, most = SEPARATORS[0], 0
    for sep in SEPARATORS:
        counts = ["".join(x.split('"')[::2]).count(sep) for x in lines]
        same = max((counts.count(c) for c in counts if c), default=0)
        if same > most:
            best, most = sep, same
    return best


def _parsed(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, n (the row's number in its file), cells: trimmed texts, as many as the row has up to its last filled cell."""
    names = [f"c{i}" for i in range(COLUMNS + 1)]
    schema = ", ".join(f"{n} string" for n in names)
    raw = spark.read.schema(schema).csv(path, sep=sep, quote='"', escape='"', multiLine=True, header=False, mode="PERMISSIVE")
    cells = F.transform(F.array(*names[:-1]), lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^\ufeff?\s+|^\ufeff|\s+$", ""))
    last = F.array_max(F.transform(cells, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    wide = F.raise_error(F.lit(f"a phenotype row has more than {COLUMNS} columns"))
    rows = raw.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("_id"), F.when(F.col(names[-1]).isNotNull(), wide.cast("array<string>")).otherwise(F.slice(cells, F.lit(1), last)).alias("cells"))
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("_id")).alias("n"), "cells")


def _score(cells: Column) -> Column:
    """Cells with a letter count three times, different and filled cells once each."""
    filled = F.filter(cells, lambda x: x != "")
    return 3 * F.size(F.filter(filled, lambda x: x.rlike("[A-Za-z]"))) + F.size(F.array_distinct(F.transform(filled, F.lower))) + F.size(filled)


def _different(cells: Column) -> Column:
    """Names of columns: an empty one is called by its place, a repeated one gets its number."""
    named = F.transform(cells, lambda x, i: F.when(x == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(x))
    earlier = lambda x, i: F.size(F.filter(F.slice(named, F.lit(1), i), lambda y: y == x))
    return F.transform(named, lambda x, i: F.when(earlier(x, i) == 0, x).otherwise(F.concat(x, F.lit(" ("), (earlier(x, i) + 1).cast("string"), F.lit(")"))))


def read_phenotypes(spark: SparkSession, path: str, sep: str | None = None) -> PhenotypeTable:
    """The phenotype tables under path. A file is a task, as a quoted cell may reach over any line end."""
    parsed = _parsed(spark, path, sep or separator_of(spark, path))
    head = parsed.filter(F.col("n") <= LOOK_AT).groupBy("file").agg(F.max(F.struct(_score(F.col("cells")).alias("score"), (-F.col("n")).alias("at"), "cells")).alias("h"))
    head = head.select("file", (-F.col("h.at")).alias("header_row"), _different(F.col("h.cells")).alias("columns"))
    plain = F.transform("columns", lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))
    first = lambda names: F.array_min(F.filter(F.transform(plain, lambda c, i: F.when(c.isin(*names), i)), lambda x: x.isNotNull()))
    head = head.select("*", *[first(names).alias(f"_{field}") for field, names in ALIASES.items()])
    places = F.array(*[F.col(f"_{f}") for f in ALIASES])
    mapping = F.map_from_entries(F.array_compact(F.array(*[F.when(F.col(f"_{f}").isNotNull(), F.struct(F.lit(f), F.get("columns", F.col(f"_{f}")))) for f in ALIASES])))
    rows = parsed.join(head, "file").filter((F.col("n") > F.col("header_row")) & (F.size("cells") > 0))
    filled = lambda at: F.nullif(F.get("cells", at), F.lit(""))
    others = F.filter(F.transform("columns", lambda c, i: F.struct(c.alias("k"), filled(i).alias("v"), i.alias("i"))), lambda x: x["v"].isNotNull() & ~F.array_contains(F.array_compact(places), x["i"]))
    number = F.row_number().over(Window.partitionBy("file").orderBy("n"))
    fields = [filled(F.col(f"_{f}")).alias(f) for f in ALIASES]
    out = rows.select("file", number.alias("row_no"), *fields, F.map_from_entries(F.transform(others, lambda x: F.struct(x["k"], x["v"]))).alias("custom"))
    return PhenotypeTable(head.select("file", "header_row", "columns", mapping.alias("mapping")), out)
