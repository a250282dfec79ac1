"""Audit of how sources diverge inside a language, from exact term counts.

The terms of a document, each behind its language, are vectorised by CountVectorizer's model: as no term belongs to two languages, one model can hold the
vocabulary of several.  A model's vocabulary passes through the driver and is broadcast, so terms are dealt by a checksum to as many models as keep
each below ``VOCABULARY_BYTES`` of counted terms; every model reads only its own share of the terms.

Documents of a source that a task meets are folded before they are vectorised; a term that occurs n times in them goes into a vector for every bit of n.
The sparse vectors are summed per language and source as whole numbers (a Summarizer's sums are means in double).  Pairs of sources are evaluated
sparsely.  With f the term of the sum and 0 for a term that a source lacks, f(p, q) = f(0, 0) + [f(p, 0) - f(0, 0)] + [f(0, q) - f(0, 0)] + rest: the first
three need a source's distinct values of p alone, and only the rest is joined by term, over terms that both sources hold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from softdeps.llm.common import map_batches, parts, stage

# Fixed values of the audit: documents that hold a term at least, ranks of terms, the unit of shares, the pseudo count.
MIN_DF, TERM_RANKS, UNIT = 3, 200, 1_000_000_000

# Most bytes of the terms that one model holds, and most sources of a language that meet in one key.
VOCABULARY_BYTES, TILE_SOURCES = 16 << 20, 64

# Bytes of texts that a task splits at once; terms (those of each split), their bytes and occurrences that it folds at once; most terms and rows of what is
# folded that are handed on together.
SPLIT_BYTES, SUM_TERMS, BAG_BYTES, BAG_TOKENS, BAG_TERMS, BAG_ROWS = 1 << 22, 1 << 21, 1 << 26, 1 << 22, 1 << 16, 32

# Cells of document vectors that a task adds up at once, and terms of sources that it ranks at once.
SUM_CELLS, RANK_ROWS = 1 << 21, 1 << 18

# A term is a run of ASCII letters and of anything beyond ASCII: in UTF-8, of these bytes; everything else parts terms.  Only A-Z are lowered.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

def terms_of(texts: list[bytes | None]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many terms each text has, and the terms in their order; the ends of a text may add empty ones."""
    lists = pc.ascii_split_whitespace(pa.array([(t or b"").translate(LETTERS) for t in texts], pa.string()))
    return lists.value_lengths().to_numpy(), lists.flatten().dictionary_encode()


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first row does."""
    first = np.zeros(len(keys[0]), bool)
    first[:1] = True
    for k in keys:
        first[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(first)


def bag_rows(groups: list[tuple[str, str]], held: list[tuple[np.ndarray, pa.DictionaryArray]]) -> pa.RecordBatch:
    """Rows of ``bags`` from the ``terms_of`` documents, whose languages and sources are ``groups``."""
    lengths = np.concatenate([n for n, _ in held])
    coded = pa.concat_arrays(pa.chunked_array([c for _, c in held]).unify_dictionaries().chunks)
    at, size = coded.indices.to_numpy(), len(coded.dictionary)
    told = (np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) << 32) + at
    empty = pc.index(coded.dictionary, "").as_py()
    told, c = np.unique(told[at != empty], return_counts=True)
    names = sorted(set(groups))
    langs = sorted({lang for lang, _ in names})
    number, lang_number = ({g: k for k, g in enumerate(x)} for x in (names, langs))
    owner, term = np.array([number[g] for g in groups], np.int64)[told >> 32], told & 0xFFFFFFFF

    def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        key = key[order]
        starts = run_starts(key)
        return key[starts], np.add.reduceat(value[order], starts) if len(starts) else value

    cells, occurrences = summed(owner * size + term, c)
    whole, df = summed(np.array([lang_number[lang] for lang, _ in names], np.int64)[owner] * size + term, np.ones(len(owner), np.int64))
    owners = [(lang, source, False) for lang, source in names] + [(lang, "", True) for lang in langs]
    ends = [*np.searchsorted(cells, np.arange(len(names) + 1) * size), *(len(cells) + np.searchsorted(whole, np.arange(1, len(langs) + 1) * size))]
    rows = [(*o, lo) for o, begin, end in zip(owners, ends, ends[1:]) for lo in range(begin, end, BAG_TERMS)]
    offsets = pa.array([lo for *_, lo in rows] + [len(cells) + len(whole)], pa.int32())
    lists = [coded.dictionary.take(pa.array(np.concatenate([cells, whole]) % size)), pa.array(np.concatenate([occurrences, df]), pa.int32())]
    columns = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.string()), (2, pa.bool_()))]
    columns += [pa.ListArray.from_arrays(offsets, x) for x in lists]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "whole", "terms", "counts"])


def bags(docs: DataFrame) -> DataFrame:
    """``(lang, source, whole, terms, counts)``: documents of a source that a task meets, folded: each term once with its occurrences.

    Rows that are ``whole`` stand for a language, with the number of documents that hold a term.  A task folds until it holds ``BAG_TOKENS`` occurrences,
    ``SUM_TERMS`` terms or ``BAG_BYTES`` of them, a row has at most ``BAG_TERMS`` terms.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, seen = [], [], np.zeros(3, np.int64)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            splits = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SPLIT_BYTES
            starts = run_starts(splits).tolist()
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                groups += zip(*(batch.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 1)), strict=True)
                lengths, coded = terms_of(texts.slice(lo, hi - lo).to_pylist())
                held.append((lengths, coded))
                seen += len(coded), len(coded.dictionary), coded.dictionary.nbytes
                if (seen >= (BAG_TOKENS, SUM_TERMS, BAG_BYTES)).any():
                    yield bag_rows(groups, held)
                    groups, held, seen = [], [], seen * 0
        if held:
            yield bag_rows(groups, held)

    return map_batches(docs.select("lang", "source", "text"), task, "lang string, source string, whole boolean, terms array<string>, counts array<int>")


def document_counts(folded: DataFrame) -> DataFrame:
    """``(named, lang, df)``: documents that hold each term, by its name behind its language."""
    each = folded.where("whole").select("lang", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    counts = each.groupBy("lang", F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
    return counts.select(F.concat("lang", F.lit(" "), "term").alias("named"), "lang", "df")


def dealt_terms(folded: DataFrame, models: int) -> DataFrame:
    """``(lang, source, terms, shift, model)``: the terms of a bag by the bits of their counts, each worth ``1 << shift`` occurrences, with rows for every model that holds some.

    So a vector of distinct terms stands for all occurrences, instead of a term repeated as often as it occurs.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, counts = batch.column(2), batch.column(3).flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            named = pc.binary_join_element_wise(batch.column(0).take(pa.array(row)), lists.flatten(), " ")
            model = np.zeros(len(row), np.int64)
            if models > 1:
                coded = named.dictionary_encode()
                share = np.fromiter(map(zlib.crc32, coded.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(coded.dictionary)) % models
                model = share[coded.indices.to_numpy()]
            bits = [np.flatnonzero(counts >> k & 1) for k in range(int(counts.max(initial=0)).bit_length())]
            at = np.concatenate([*bits, np.empty(0, np.int64)]).astype(np.int64)
            shift = np.repeat(np.arange(len(bits)), [len(x) for x in bits]).astype(np.int64)
            order = np.argsort((row[at] * models + model[at]) * 32 + shift, kind="stable")  # 31 bits of a count; ``at`` ascends in each
            at, shift = at[order], shift[order]
            starts = run_starts(row[at], model[at], shift)
            terms = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), named.take(pa.array(at)))
            lang, source = (batch.column(c).take(pa.array(row[at[starts]])) for c in (0, 1))
            columns = [lang, source, terms, pa.array(shift[starts], pa.int32()), pa.array(model[at[starts]], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "terms", "shift", "model"])

    rows = folded.where("not whole").select("lang", "source", "terms", "counts")
    return map_batches(rows, task, "lang string, source string, terms array<string>, shift int, model int", BAG_ROWS)


def indices(vectors: DataFrame) -> DataFrame:
    """``(named, i)`` from ``vector``s of one term each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).field("indices").flatten()], names=["named", "i"])

    return map_batches(vectors.select("named", "vector"), task, "named string, i int")


def vector_sums(vectors: DataFrame) -> DataFrame:
    """``(lang, source, i, c, c_lang)``: sums of the sparse ``vector`` column, times ``1 << shift``, by group, and by term alone.

    A task adds up ``SUM_CELLS`` cells at a time before anything is shuffled.  Cells are dealt by term, so that what follows by term needs no further shuffle.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> pa.RecordBatch:
            at, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(at)
            at, c = at[order], c[order]
            starts = run_starts(at)
            c = np.add.reduceat(c, starts) if len(starts) else c
            groups = pa.array((at[starts] >> 32).astype(np.int32))
            lang, source = (pa.array([g[k] for g in code], pa.string()).take(groups) for k in (0, 1))
            columns = [lang, source, pa.array((at[starts] & 0xFFFFFFFF).astype(np.int32)), pa.array(c)]
            held.clear()
            code.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "i", "c"])

        for batch in batches:
            vector = batch.column(2)
            lengths = vector.field("indices").value_lengths().to_numpy(zero_copy_only=False)
            group = [code.setdefault(g, len(code)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            at = (np.repeat(np.array(group, np.int64), lengths) << 32) + vector.field("indices").flatten().to_numpy()
            c = vector.field("values").flatten().to_numpy().astype(np.int64) << np.repeat(batch.column(3).to_numpy().astype(np.int64), lengths)
            held.append((at, c))
            if sum(len(x) for x, _ in held) >= SUM_CELLS:
                yield summed()
        if held:
            yield summed()

    cells = map_batches(vectors.select("lang", "source", "vector", "shift"), task, "lang string, source string, i int, c long")
    sums = cells.repartition("i").groupBy("lang", "source", "i").agg(F.sum("c").alias("c"))
    return sums.withColumn("c_lang", F.sum("c").over(Window.partitionBy("i")))


def term_counts(docs: DataFrame, min_df: int = MIN_DF, vocabulary_bytes: int = VOCABULARY_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(lang, source, t, term, c, c_lang)`` for kept terms that a source holds, ``t`` numbers them; ``(lang, v)``, kept terms of a language.

    No null in lang or source.  The vocabulary is that of ``CountVectorizer(minDF=min_df, vocabSize=2**31 - 1)``: as the number of models needs the terms'
    document counts beforehand, a model is fitted to the terms that reach ``min_df``, one row each, instead of counting all documents' terms again.
    """
    spark = docs.sparkSession
    folded = stage(bags(docs), "bags", ("whole",))
    kept = document_counts(folded).where(F.col("df") >= min_df).select("named", "lang", F.crc32(F.col("named").cast("binary")).alias("share"))
    kept = stage(kept, "kept")
    models = parts(kept.agg(F.sum(F.octet_length("named") + 8)).first()[0] or 0, vocabulary_bytes)
    dealt = stage(dealt_terms(folded, models), "terms", ("model",))
    sums = []
    for m in range(models):
        own = kept.where(F.col("share") % models == m).select("named", F.array("named").alias("terms"))
        if own.isEmpty():
            continue
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=1.0, vocabSize=2**31 - 1).fit(own)
        names = stage(indices(model.transform(own)), "names")
        cells = vector_sums(model.transform(dealt.where(F.col("model") == m))).join(names, "i")
        number = F.col("i") + F.lit(m << 32)
        sums.append(stage(cells.select("lang", "source", number.alias("t"), F.substring_index("named", " ", -1).alias("term"), "c", "c_lang"), "counts"))
    none = spark.createDataFrame([], "lang string, source string, t long, term string, c long, c_lang long")
    return reduce(DataFrame.unionAll, sums, none), kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))


def share_of(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (c + 1) / (n + v)), exact beyond a long's range; decimals, which are slow, only there."""
    wide = lambda x: x.cast("decimal(19,0)")
    up = F.lit(UNIT).cast("decimal(10,0)") * wide(c + 1)
    near = F.call_function("div", F.lit(UNIT).cast("long") * (c + 1), n + v)
    return F.when(c < F.lit((1 << 63) // UNIT - 1), near).otherwise(F.call_function("div", up, wide(n + v))) + 1


def differ(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _tiled(left: DataFrame, right: DataFrame, on: list[str], tiles: int, unlike: str) -> DataFrame:
    """Joins rows of sources ``a`` and ``b`` where ``unlike`` holds; a key holds two tiles of sources, not all."""
    tile = lambda c: F.pmod(F.xxhash64(c), F.lit(tiles)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    a = left.withColumn("#a", tile("a")).withColumn("#b", each)
    b = right.withColumn("#b", tile("b")).withColumn("#a", each)
    return a.join(b, [*on, "#a", "#b"]).where(unlike)


def foremost(told: DataFrame, ranks: int) -> DataFrame:
    """``told`` without rows that ``ranks`` rows of their language and source exceed in a task: none of them can reach these ranks."""

    def best(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        value = table.column("value").to_numpy()
        order = np.lexsort((-value, group))
        starts = run_starts(group[order])
        sizes = np.diff(np.append(starts, len(order)))
        last = value[order][starts + np.minimum(sizes, ranks) - 1]
        return table.take(pa.array(order[value[order] >= np.repeat(last, sizes)]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= RANK_ROWS:
                held = best(pa.Table.from_batches(held)).to_batches()
                rows = sum(b.num_rows for b in held)
                if rows >= RANK_ROWS // 2:  # many ties or groups
                    yield from held
                    held, rows = [], 0
        if rows:
            yield from best(pa.Table.from_batches(held)).to_batches()

    return map_batches(told, task, "lang string, source string, part string, item string, value long", RANK_ROWS)


def exact_sum(value: Column) -> list[Column]:
    """Sums of a long's halves: no single sum leaves the range of a long before 2^31 rows."""
    return [F.sum(F.shiftright(value, 32)).alias("high"), F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")]


def source_divergence(
    docs: DataFrame, min_df: int = MIN_DF, term_ranks: int = TERM_RANKS, vocabulary_bytes: int = VOCABULARY_BYTES, tile_sources: int = TILE_SOURCES
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source is from the others of its language, and by which terms from its language.

    Null text, lang and source are read as empty.  Every occurring pair of lang and source is a group, even without terms; where a language keeps no
    term, its pairs have value 0.  Repeated rows are documents of their own.  Ties go by the item.  An empty table gives no rows; further columns are left out.
    """
    clean = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts, sizes = term_counts(clean, min_df, vocabulary_bytes)
    own = counts.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = clean.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n", "v"])
    groups = stage(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count(F.lit(1)).alias("sources"))
    tiles = parts(langs.agg(F.max("sources")).first()[0] or 0, tile_sources)

    none = F.when(F.col("v") > 0, share_of(F.lit(0), F.col("n"), F.col("v"))).otherwise(1)
    groups = groups.withColumn("p0", none)
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", share_of(F.col("c"), F.col("n"), F.col("v")))
    shares = stage(shares.select("lang", "source", "t", "term", "c_lang", "p", "p0", "v"), "shares")
    levels = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("k"))

    def side(df: DataFrame, s: str) -> DataFrame:
        """The rows of side ``a`` or ``b``: its source under that name, its values with that name behind theirs."""
        keys = [c for c in ("lang", "t") if c in df.columns]
        return df.select(*keys, F.col("source").alias(s), *(F.col(c).alias(f"{c}{s}") for c in df.columns if c not in (*keys, "source")))

    wide = lambda x: x.cast("decimal(38,0)")
    pa_, pb, p0a, p0b = (F.col(c) for c in ("pa", "pb", "p0a", "p0b"))
    ends, terms = groups.select("lang", "source", "p0", "v"), shares.select("lang", "t", "source", "p", "p0")
    pieces = [
        (_tiled(side(ends, "a"), side(ends, "b"), ["lang"], tiles, "a <> b"), wide(F.col("va")) * wide(differ(p0a, p0b))),
        (_tiled(side(levels, "a"), side(ends, "b"), ["lang"], tiles, "a <> b"), wide(F.col("ka")) * wide(differ(pa_, p0b) - differ(p0a, p0b))),
        (_tiled(side(ends, "a"), side(levels, "b"), ["lang"], tiles, "a <> b"), wide(F.col("kb")) * wide(differ(p0a, pb) - differ(p0a, p0b))),
    ]
    # both directions of a pair from one meeting of its terms
    rest = lambda x, y, x0, y0: differ(x, y) - differ(x, y0) - differ(x0, y) + differ(x0, y0)
    there = rest(pa_, pb, p0a, p0b)
    back = rest(pb, pa_, p0b, p0a)
    met = _tiled(side(terms, "a"), side(terms, "b").drop("lang"), ["t"], tiles, "a < b").select("lang", "a", "b", there.alias("there"), back.alias("back"))
    halves = [c.alias(f"{way}_{half}") for way in ("there", "back") for half, c in zip(("high", "low"), exact_sum(F.col(way)), strict=True)]
    both = met.groupBy("lang", "a", "b").agg(*halves)
    whole_of = lambda way: wide(F.col(f"{way}_high")) * wide(F.lit(1 << 32)) + wide(F.col(f"{way}_low"))
    ways = F.explode(F.array(F.struct("a", "b", whole_of("there").alias("v")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), whole_of("back").alias("v"))))
    shared = both.select("lang", ways.alias("w")).select("lang", "w.a", "w.b", F.col("w.v").alias("value"))
    summed = reduce(DataFrame.unionAll, [m.select("lang", "a", "b", wide(value).alias("value")) for m, value in pieces], shared.select("lang", "a", "b", wide(F.col("value")).alias("value")))
    value = F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value")
    pairs = summed.groupBy("lang", "a", "b").agg(value).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")

    against = shares.join(langs, "lang").withColumn("q", share_of(F.col("c_lang"), F.col("n_lang"), F.col("v"))).where("p > q")
    told = foremost(against.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value")), term_ranks)
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc()))
    terms = told.withColumn("rank", rank).where(F.col("rank") <= term_ranks)
    return pairs.withColumn("rank", rank).unionAll(terms)
