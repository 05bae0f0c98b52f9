"""Sinks: exports as text rows, syntax generators, change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MISSING = "-999"


def csv_lines(df: DataFrame, missing: str = MISSING, decimals: int = 4, legacy: bool = False) -> DataFrame:
    """line: the rows as CSV. Doubles get fixed decimals; arrays are joined by `; `; quoting is RFC 4180.

    legacy: a lone quote is doubled but the field not quoted, and whole numbers get decimals too.
    """

    def field(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith("array"):
            text = F.concat(F.lit('"'), F.replace(F.array_join(c.cast("array<string>"), "; "), F.lit('"'), F.lit('""')), F.lit('"'))
        elif kind in ("double", "float") or kind.startswith("decimal") or (legacy and kind in ("int", "bigint")):
            text = F.format_string(f"%.{decimals}f", c.cast("double"))
        else:
            text = F.replace(c.cast("string"), F.lit('"'), F.lit('""'))
            text = F.when(c.cast("string").rlike("[,\n]" if legacy else '[,"\n]'), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text)
        return F.coalesce(text, F.lit(missing))

    return df.select(F.concat_ws(",", *[field(n, k) for n, k in df.dtypes]).alias("line"))


def write_csv(df: DataFrame, path: str, **options) -> None:
    header = df.sparkSession.createDataFrame([(",".join(df.columns),)], "line string")
    header.coalesce(1).write.mode("overwrite").text(f"{path}/header")
    csv_lines(df, **options).write.mode("overwrite").text(f"{path}/rows")


def json_rows(df: DataFrame) -> DataFrame:
    """df with value: each row as a JSON object."""
    return df.select("*", F.to_json(F.struct(*df.columns)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).select("value").write.mode("overwrite").text(path)


def json_envelope(df: DataFrame, language: str = "en", labels: dict[str, str] | None = None, exported: str = "") -> str:
    """Head of a JSON export; the rows follow from write_json."""
    import json

    return json.dumps({"exportDate": exported, "totalRecords": df.count(), "language": language, "variableLabels": labels or {}})


#: Labels of an export's variables by language, and of coded values.
LABELS = {
    "en": {"faithfulness": "Faithfulness", "answer_relevancy": "Answer relevancy", "context_precision": "Context precision", "context_recall": "Context recall", "hallucination_rate": "Hallucination rate", "total_ms": "Total latency (ms)"},
    "id": {"faithfulness": "Kesetiaan", "answer_relevancy": "Relevansi jawaban", "context_precision": "Presisi konteks", "context_recall": "Perolehan konteks", "hallucination_rate": "Tingkat halusinasi", "total_ms": "Latensi total (ms)"},
}
VALUE_LABELS = {"retrieval": {"vector": "Vector", "keyword": "BM25", "hybrid": "Hybrid"}, "agentic": {"0": "No", "1": "Yes"}}


def json_document(df: DataFrame, language: str = "en", exported: str = "") -> DataFrame:
    """value: the whole export as one JSON object, its envelope and its rows; for exports that one object can hold."""
    rows = df.agg(F.collect_list(F.to_json(F.struct(*df.columns))).alias("rows"))
    head = json_envelope(df, language, {k: v for k, v in LABELS[language].items() if k in df.columns}, exported)
    return rows.select(F.concat(F.lit(head[:-1] + ', "data": ['), F.array_join("rows", ","), F.lit("]}")).alias("value"))


def spss_syntax(df: DataFrame, data_file: str = "data.csv", labels: dict[str, str] | None = None, value_labels: dict[str, dict[str, str]] | None = None) -> str:
    """Syntax that reads the CSV, labels its variables and their values, and describes the numbers."""
    labels, value_labels = labels or {}, VALUE_LABELS if value_labels is None else value_labels
    number = {"double", "float", "int", "bigint"}
    kinds = [(n, "F10.4" if k in number else "A255") for n, k in df.dtypes]
    numeric = [n for n, k in kinds if k != "A255"]
    out = [f'GET DATA /TYPE=TXT /FILE="{data_file}" /DELIMITERS="," /QUALIFIER=\'"\' /FIRSTCASE=2', "  /VARIABLES=", *[f"    {n} {k}" for n, k in kinds], "."]
    out += ["VARIABLE LABELS", *[f'  {n} "{labels.get(n, n)}"' for n, _ in kinds], "."]
    for n, k in kinds:
        if n in value_labels:
            quoted = (lambda v: f"'{v}'") if k == "A255" else str
            out.append(f"VALUE LABELS {n} " + " ".join(f"{quoted(v)} '{said}'" for v, said in value_labels[n].items()) + ".")
    if numeric:
        out += [f"MISSING VALUES {' '.join(numeric)} ({MISSING}).", f"DESCRIPTIVES VARIABLES={' '.join(numeric[:20])} /STATISTICS=MEAN STDDEV MIN MAX."]
        out += [f"CORRELATIONS /VARIABLES={' '.join(numeric[:10])}.", f"RELIABILITY /VARIABLES={' '.join(numeric[:10])} /MODEL=ALPHA."]
    for a, b in zip(numeric[::2], numeric[1:4:2]):
        out.append(f"T-TEST PAIRS={a} WITH {b} (PAIRED).")
    return "\n".join(out)


def export(df: DataFrame, form: str, path: str | None = None, **options):
    """An export by form: csv and json are written under path, spss, python and r are texts of scripts.

    options are those of the form's own function. Scripts need no rows.
    """
    if form in ("csv", "json") and path is None:
        raise ValueError("an export of rows needs a path")
    makers = {"csv": lambda: write_csv(df, path, **options), "json": lambda: write_json(df, path), "spss": lambda: spss_syntax(df, **options)}
    makers |= {f: (lambda f=f: analysis_script(df, path=path or "export.parquet", flavour=f, **options)) for f in ("python", "r")}
    if form not in makers:
        raise ValueError(f"no such export: {form}")
    return makers[form]()


def insert_chunks(chunks: DataFrame, documents: DataFrame, path: str) -> DataFrame:
    """Appends chunks; documents with processing_status and processing_error after it, `failed` if the write failed.

    The write is whole or nothing, so a failure leaves no rows to take back.
    """
    try:
        append(chunks, path)
        status, error = "completed", None
    except Exception as e:  # noqa: BLE001  any failure is the documents' status
        status, error = "failed", str(e).split("\n")[0]
    return documents.withColumn("processing_status", F.lit(status)).withColumn("processing_error", F.lit(error).cast("string"))


def analysis_script(df: DataFrame, group: str, values: list[str], path: str, flavour: str = "python") -> str:
    """A script that repeats the main statistics on an export: PySpark with this package, or R."""
    if flavour == "r":
        tests = [f"print(summary(d${v})); print(summary(aov({v} ~ {group}, data=d))); print(TukeyHSD(aov({v} ~ factor({group}), data=d)))" for v in values]
        pairs = [f"print(t.test(d${a}, d${b}, paired=TRUE)); print(cor.test(d${a}, d${b}))" for a, b in zip(values, values[1:])]
        return "\n".join([f'd <- read.csv("{path}", na.strings="{MISSING}")', *tests, *pairs])
    lines = ["from pyspark.sql import SparkSession", "from lexivec.operators import stats", "spark = SparkSession.builder.getOrCreate()", f'd = spark.read.parquet("{path}")']
    each = [f'stats.describe(d, ["{group}"], "{v}").show(); stats.anova(d, "{group}", "{v}").show(); stats.tukey(d, "{group}", "{v}").show(); stats.mean_interval(d, ["{group}"], "{v}").show()' for v in values]
    pairs = [f'stats.paired_t(d, [], "{a}", "{b}").show()' for a, b in zip(values, values[1:])]
    both = [f"stats.pearson(d, {values!r}).show(); stats.cronbach(d, {values!r}).show()"] if len(values) > 1 else []
    return "\n".join([*lines, *each, *pairs, *both])


def export_rows(questions: DataFrame, numeric: list[str] | None = None, text: list[str] | None = None) -> DataFrame:
    """The export's fields: texts with empty strings for nulls, numbers as they are. By their types, unless they are named."""
    kinds = dict(questions.dtypes)
    text = [c for c, k in kinds.items() if k == "string"] if text is None else text
    numeric = [c for c, k in kinds.items() if k in ("double", "float", "int", "bigint", "boolean")] if numeric is None else numeric
    return questions.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in text], *[F.col(c) for c in numeric])


def append(df: DataFrame, path: str) -> None:
    """Adds rows; Spark's commit protocol makes the addition whole or nothing."""
    df.write.mode("append").parquet(path)


def current(log: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key in an append-only log."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def without(df: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """df without the keys that were deleted."""
    return df.join(tombstones.select(key), key, "left_anti")


def cascade(tables: dict[str, DataFrame], tombstones: DataFrame, root: str, key: str, children: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """Deletes keys of a root table and, along foreign keys (child: (column, parent column)), the rows that refer to them."""
    out = {root: without(tables[root], tombstones, key)}
    for child, (column, parent) in children.items():
        gone = tables[root].join(tombstones, key, "left_semi").select(F.col(parent).alias(column))
        out[child] = tables[child].join(gone, column, "left_anti")
    return out


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)
