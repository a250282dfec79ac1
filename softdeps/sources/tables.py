"""Delimited files: scan, missing markers, type inference, dialect inference, corpora."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softdeps.operators.pairs import q
from softdeps.session import stage

# Text read as a missing value besides the given marker.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Texts that count as numbers: no type suffixes, which a cast would take.
NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?:[Nn]a[Nn]|[Ii]nf(?:inity)?)"

# Date formats tried in this order when none is given.
DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy"]
SEPARATORS = [";", ",", "\t", "|", ":"]


def read_table(
    spark: SparkSession,
    path: str,
    sep: str = ";",
    header: bool = True,
    missing: str = "?",
    schema: T.StructType | None = None,
    datetime_cols: list[str | int] | None = None,
    date_format: str | None = None,
) -> DataFrame:
    """A delimited file with missing markers as null and typed columns (given by ``schema`` or inferred)."""
    raw = spark.read.csv(path, sep=sep, header=header, inferSchema=False)
    markers = MISSING + [missing]
    cells = {c: F.when(~F.trim(q(c)).isin(markers), q(c)) for c in raw.columns}
    text = raw.select(*[e.alias(c) for c, e in cells.items()])
    dates = {raw.columns[c] if isinstance(c, int) else c for c in datetime_cols or []}
    if schema is None:
        types = infer_types(text, [c for c in raw.columns if c not in dates])
        names = raw.columns
    else:
        types = {c: f.dataType.simpleString() for c, f in zip(raw.columns, schema.fields)}
        names = schema.names
    typed = lambda c: parse_date(q(c), date_format) if c in dates else q(c).cast(types[c])
    return text.select(*[typed(c).alias(n) for c, n in zip(raw.columns, names)])


def parse_date(c: Column, date_format: str | None = None) -> Column:
    """Timestamp from text, null where no format fits."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in ([date_format] if date_format else DATE_FORMATS)])


def infer_types(text: DataFrame, columns: list[str]) -> dict[str, str]:
    """The narrowest of bigint, double, boolean and string that every present value of a column fits; one pass."""
    if not columns:
        return {}
    numeric = lambda c: F.trim(q(c)).rlike(f"^(?:{NUMBER})$")
    fits = lambda c, t: F.coalesce(F.bool_and((q(c).try_cast(t).isNotNull() & numeric(c)) | q(c).isNull()), F.lit(True))
    is_bool = lambda c: F.coalesce(F.bool_and(F.lower(F.trim(q(c))).isin("true", "false") | q(c).isNull()), F.lit(True))
    checks = [
        F.struct(
            F.count(q(c)).alias("n"), fits(c, "bigint").alias("bigint"), fits(c, "double").alias("double"), is_bool(c).alias("boolean")
        ).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]
    row = text.agg(*checks).first()
    pick = lambda r: "double" if r["n"] == 0 else next((t for t in ("bigint", "double", "boolean") if r[t]), "string")
    return {c: pick(row[f"c{i}"]) for i, c in enumerate(columns)}


def infer_dialect(spark: SparkSession, path: str, sep: str | None = None) -> tuple[str, bool]:
    """Separator and header presence, from all lines; what stands in quotes does not count.

    The separator is the candidate that cuts every line into the same, largest number of fields.  The first line is a header when some column is numeric below
    it but not in it (or the reverse), or when none of its texts recurs below.  In a folder of part files their repeated first lines count as headers.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.first()
    if first is None:
        raise ValueError(f"no lines in {path}")
    if sep is None:
        bare = F.regexp_replace("value", '"[^"]*"', "")
        found = lambda s: F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit("")))
        spread = lines.agg(*[f(found(s)) for s in SEPARATORS for f in (F.min, F.max)]).first()
        ranges = {s: spread[2 * i : 2 * i + 2] for i, s in enumerate(SEPARATORS)}
        stable = {s: hi for s, (lo, hi) in ranges.items() if lo == hi and hi}
        counts = stable or {s: hi for s, (_, hi) in ranges.items() if hi}
        sep = max(counts, key=counts.get) if counts else ","
    cells = spark.read.csv(path, sep=sep, header=False, inferSchema=False)
    head = cells.first()
    names = cells.columns
    body = cells.where(~F.coalesce(F.struct(*names).eqNullSafe(F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, head)])), F.lit(False)))
    checks = [F.count(F.lit(1)).alias("n")]
    for name, top in zip(names, head):
        value = F.trim(F.col(name))
        known = ~value.isin([*MISSING, "?"]) & value.isNotNull()
        numeric = value.rlike(f"^(?:{NUMBER})$")
        checks += [F.bool_and(F.when(known, numeric)), F.bool_or(F.when(known, numeric)), F.bool_or(known & (value == F.lit((top or "").strip())))]
    n, *flags = body.agg(*checks).first()
    if not n:
        return sep, True
    tops = [bool(re.fullmatch(NUMBER, (v or "").strip())) for v in head]
    every, some, recurs = flags[0::3], flags[1::3], flags[2::3]
    if any(a is not None and a == b and a != top for a, b, top in zip(every, some, tops)):
        return sep, True
    return sep, not any(tops) and not any(recurs)


def read_corpus(spark: SparkSession, folder: str, suffix: str = ".csv", skip_prefix: str = "distance", **options) -> dict[str, DataFrame]:
    """Every delimited file of a folder, by name; dialects are inferred unless given."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    names = sorted(f.getPath().getName() for f in files)
    out = {}
    for name in names:
        if name.endswith(suffix) and not name.startswith(skip_prefix):
            path = f"{folder.rstrip('/')}/{name}"
            sep, header = infer_dialect(spark, path, sep=options.get("sep"))
            out[name] = read_table(spark, path, **{"sep": sep, "header": header, **options})
    return out


def first_lines(lines: DataFrame) -> DataFrame:
    """``(ds_name, path, value, block)``: of ``lines`` in the order of their files, the first of every block of a file."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            path, block = batch.column(1), batch.column(3)
            told = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(block[1:], block[:-1])).to_pylist()
            yield batch.filter(pa.array([(path[0].as_py(), block[0].as_py()) != last, *told]))
            last = path[-1].as_py(), block[-1].as_py()

    return lines.select("ds_name", "path", "value", "block").mapInArrow(task, "ds_name string, path string, value string, block bigint")


def corpus_profile(spark: SparkSession, folder: str, suffix: str = ".csv", skip_prefix: str = "distance", missing: str = "?") -> DataFrame:
    """One row per delimited table of a folder: ``ds_name, sep, header, ds_len, ds_attr_size, types, ds_files, ds_file_size_B, pairs``.

    A table is a file of the folder or a folder of part files, each with its own header line.  Dialect and types follow the rules of ``infer_dialect`` and
    ``infer_types``, but as aggregates by table: three scans and the same jobs for any number of tables.  Tables without a line are left out.
    All that is aggregated over lines and cells are numbers and flags, and tables are staged, one small row each: no task sorts lines or holds those of a table.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getName()
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(folder)
    path = F.col("_metadata.file_path")
    lines = found.select(
        F.regexp_extract(path, f"/{re.escape(root)}/([^/]+)", 1).alias("ds_name"),
        path.alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    )
    lines = lines.where((F.trim("value") != "") & F.col("ds_name").endswith(suffix) & ~F.col("ds_name").startswith(skip_prefix))

    bare = F.regexp_replace("value", '"[^"]*"', "")
    cuts = [F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) for s in SEPARATORS]
    bounds = [f(cut).alias(f"{name}{i}") for i, cut in enumerate(cuts) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    files = lines.groupBy("ds_name", "path", "size").agg(F.count(F.lit(1)).alias("lines"), *bounds)
    files = files.join(first_lines(lines).groupBy("ds_name", "path").agg(F.min_by("value", "block").alias("top")), ["ds_name", "path"])
    numbers = range(len(SEPARATORS))
    tables = files.groupBy("ds_name").agg(
        F.count(F.lit(1)).alias("ds_files"),
        F.sum("size").alias("ds_file_size_B"),
        F.sum("lines").alias("lines"),
        F.min_by("top", "path").alias("top"),
        *[f(f"{name}{i}").alias(f"{name}{i}") for i in numbers for f, name in ((F.min, "lo"), (F.max, "hi"))],
    )
    steady = lambda i: F.col(f"lo{i}") == F.col(f"hi{i}")
    usable = [F.when(F.col(f"hi{i}") > 0, F.struct(steady(i).alias("steady"), F.col(f"hi{i}").alias("n"), F.lit(-i).alias("order"), F.lit(s).alias("sep"))) for i, s in enumerate(SEPARATORS)]
    sep = F.coalesce(F.array_max(F.array(*usable))["sep"], F.lit(","))
    tables = tables.select("ds_name", "ds_files", "ds_file_size_B", "lines", "top", sep.alias("sep"))
    outside = F.concat(F.lit("\\Q"), F.col("sep"), F.lit('\\E(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    plain = lambda c: F.replace(F.regexp_replace(F.trim(c), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    tables = stage(tables.withColumn("tops", F.split("top", outside, -1)), "tables")
    cells = lines.join(tables, "ds_name").select(
        "ds_name", (F.col("value") == F.col("top")).alias("is_top"), "tops", F.posexplode(F.split("value", outside, -1)).alias("at", "cell")
    )
    cells = cells.select("ds_name", "is_top", "at", plain(F.col("cell")).alias("v"), plain(F.get("tops", F.col("at"))).alias("top"))
    known = ~F.col("v").isin([*MISSING, missing])
    number = lambda c: c.rlike(f"^(?:{NUMBER})$")
    fits = {
        "bigint": number(F.col("v")) & F.col("v").try_cast("bigint").isNotNull(),
        "double": number(F.col("v")) & F.col("v").try_cast("double").isNotNull(),
        "boolean": F.lower("v").isin("true", "false"),
    }
    body = lambda test: F.when(known & ~F.col("is_top"), test)
    columns = cells.groupBy("ds_name", "at", "top").agg(
        F.bool_and(body(number(F.col("v")))).alias("every"),
        F.bool_or(body(number(F.col("v")))).alias("some"),
        F.coalesce(F.bool_or(body(F.col("v") == F.col("top"))), F.lit(False)).alias("recurs"),
        F.count_if(~F.col("is_top")).alias("body"),
        *[F.bool_and(body(test)).alias(f"below_{t}") for t, test in fits.items()],
        *[F.bool_and(F.when(known, test)).alias(f"all_{t}") for t, test in fits.items()],
    )

    def narrowest(prefix: str) -> Column:
        out = F.when(F.col(f"{prefix}_double").isNull(), "double")
        for t in fits:
            out = out.when(F.col(f"{prefix}_{t}"), t)
        return out.otherwise("string")

    top_number = F.coalesce(number(F.col("top")), F.lit(False))
    headers = columns.groupBy("ds_name").agg(
        F.count(F.lit(1)).alias("ds_attr_size"),
        F.max("body").alias("body"),
        F.coalesce(F.bool_or((F.col("every") == F.col("some")) & (F.col("every") != top_number)), F.lit(False)).alias("turns"),
        F.bool_or(top_number | F.col("recurs")).alias("same"),
        F.sort_array(F.collect_list(F.struct("at", narrowest("below").alias("below"), narrowest("all").alias("every")))).alias("found"),
    )
    header = (F.col("body") == 0) | F.col("turns") | ~F.col("same")
    rows = F.col("lines") - F.when(F.col("header"), F.col("ds_files")).otherwise(0)
    types = F.when(F.col("header"), F.col("found.below")).otherwise(F.col("found.every"))
    out = tables.join(headers, "ds_name").withColumn("header", header).withColumn("ds_len", rows)
    pairs = F.floor(F.col("ds_len") * (F.col("ds_len") - 1) / 2).cast("bigint")
    return out.select("ds_name", "sep", "header", "ds_len", "ds_attr_size", F.array_join(types, ",").alias("types"), "ds_files", "ds_file_size_B", pairs.alias("pairs"))
