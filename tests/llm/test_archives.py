"""Archives, Merkle manifests and source divergence against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from softdeps.llm import divergence, warc
from softdeps.llm.divergence import source_divergence
from softdeps.llm.merkle import merkle_audit, merkle_manifest
from softdeps.llm.warc import fetch_records, parse_record, read_bundles, read_seek_table, record_index, save_bundles, write_bundles

PAGE = "page_id long, url string, html string, content string, bundle int"


def pages():
    rng = random.Random(3)
    long = ["<p>" + " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(n)) + "é</p>" for n in (40, 60, 90, 4000)]
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 7 == 0 else f"http://h/{i}", rng.choice(long + ["short", "", None, f"own {i} " * 30])) for i in range(120)]
    rows += [(None, None, long[0]), (None, "u", "x" * 200), (None, "u", "x" * 200), (5, rows[5][1], rows[5][2]), (900, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    return [(*r, "extra", 1) for r in rows]


def told(rows):
    """What the contract says of each row, and its payload."""
    groups = {}
    for pid, _, html, *_ in rows:
        payload = (html or "").encode()
        if len(payload) >= 100:
            groups.setdefault(payload, []).append(pid)
    out = []
    for pid, _, html, *_ in rows:
        payload = (html or "").encode()
        ids = [i for i in groups.get(payload, []) if i is not None]
        first = min(ids) if ids else None
        revisit = payload in groups and pid != first
        out.append((pid, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else payload))
    return out


@pytest.mark.parametrize("hot_share", [1000, 5])
def test_warc_round_trip(spark, monkeypatch, tmp_path, hot_share):
    monkeypatch.setattr(warc, "HOT_SHARE", hot_share)  # 5: every copied payload is joined, none broadcast
    rows = pages()
    bundles = write_bundles(spark.createDataFrame(rows, PAGE).repartition(3), frame_bytes=2000, bundle_bytes=3000)
    key = lambda r: tuple((v is None, v) for v in r[:5])
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in read_bundles(bundles).collect()]
    assert sorted(found, key=key) == sorted(told(rows), key=key)
    assert bundles.count() > 3

    index = record_index(bundles)
    contents = {r.bundle: bytes(r.content) for r in bundles.collect()}
    for e in index.collect():  # the index against a plain decoder that ignores the seek table
        place, size, plain, _ = read_seek_table(contents[e.bundle])[e.frame]
        alone = zstandard.ZstdDecompressor().decompress(contents[e.bundle][place : place + size], max_output_size=plain)
        head, _, end = parse_record(alone, e.offset)
        assert head[b"WARC-Record-ID"].decode() == e.record_id and end - e.offset == e.length
    whole = [zstandard.ZstdDecompressor().stream_reader(c, read_across_frames=True).read() for c in contents.values()]
    assert sum(w.count(b"WARC-Type: ") for w in whole) == len(rows)

    wanted = spark.createDataFrame([("<urn:page:5>",), ("<urn:page:17>",), ("<urn:page:->",), ("<urn:page:17>",)], "record_id string")
    assert Counter(r.page_id for r in fetch_records(bundles, index, wanted).collect()) == {5: 2, 17: 1, None: 3}

    save_bundles(bundles, str(tmp_path))
    files = spark.read.format("binaryFile").load(str(tmp_path) + "/*.warc.zst")
    assert read_bundles(files, with_payload=False).count() == len(rows)


def test_warc_damage_and_empty(spark):
    bundles = write_bundles(spark.createDataFrame(pages()[:9], PAGE))
    broken = bundles.withColumn("content", F.expr("overlay(content placing X'00' from 30 for 1)"))
    with pytest.raises(Exception, match="(?i)checksum|zstd|frame|decompress"):
        read_bundles(broken).collect()
    none = write_bundles(spark.createDataFrame([], PAGE))
    assert read_bundles(none).collect() == [] and record_index(none).collect() == []


H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(level, i):
    """Root over ``level`` and the siblings (left, right) of node ``i``."""
    path = []
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        run, at = runs[i // 16], i % 16
        path.append(("".join(run[:at]), "".join(run[at + 1 :])))
        level, i = [H(*r) for r in runs], i // 16
    return level[0], path


def brute_manifest(rows):
    def leaf(row, text):
        fields = (row[0], row[2], row[3], row[4], text)
        return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    def tampered(row):
        lower = row[1] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        return re.sub("[A-Z]", lambda m: m[0].lower(), row[1]) if lower else row[1]

    sources = {}
    for row in rows:
        sources.setdefault(row[2], []).append((leaf(row, row[1]), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0]))
    subroots = {s: climb([h for h, _ in sources[s]], 0)[0] for s in names}
    out = []
    for k, s in enumerate(names):
        root, top = climb([subroots[n] for n in names], k)
        for i, (h, row) in enumerate(sources[s]):
            path = climb([x for x, _ in sources[s]], i)[1] + top
            own = leaf(row, tampered(row))
            for left, right in path:
                own = H(left, own, right)
            out.append((row[0], h, subroots[s], root, H(*(a + b for a, b in path)), own, own == root))
    return out


DOC = "doc_id long, text string, source string, lang string, n_chars long, hash int, item string"


@pytest.mark.parametrize("digits", [1, 3])
def test_merkle_against_brute_force(spark, digits):
    rng = random.Random(8)
    sizes = {"hot": 700, None: 17, "": 16, "b": 256, "é": 1, "z": 257, **{f"s{i}": 2 for i in range(20)}}
    rows = [(rng.randrange(10**6), rng.choice(["Ab C", "", None, "x" * 5000, f"T{i}é"]), s, rng.choice(["en", None]), i, 1, "x") for s, n in sizes.items() for i in range(n)]
    rows += [(None, "No Id", "b", None, None, 1, "x")] * 2 + [(7, "A", "b", None, 1, 2, "x"), (7, "B", "b", None, 1, 2, "x")]
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    key = lambda r: tuple((v is None, v) for v in r)
    found = [tuple(r) for r in merkle_audit(docs, digits).collect()]
    assert sorted(found, key=key) == sorted(brute_manifest(rows), key=key)
    assert {v for *_, v in found} == {True, False}


def test_merkle_lone_leaf_and_empty(spark):
    one = merkle_manifest(spark.createDataFrame([(1, "a", "s", "en", 1, 1, "x")], DOC)).first()
    assert one.leaf == one.subroot == one.root and one.path == []
    assert merkle_audit(spark.createDataFrame([], DOC)).collect() == []


def brute_divergence(rows, min_df=3, ranks=200):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for la, _, w in docs if la == lang for t in set(w))
        kept = [t for t, n in df.items() if n >= min_df]
        counts = {}
        for la, source, w in docs:
            if la == lang:
                counts.setdefault(source, Counter()).update(t for t in w if df[t] >= min_df)
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        shares, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pair = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in counts if o != s]
            term = [(t, f(shares[s][t], q[t])) for t in kept if counts[s][t] and shares[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, o, v, k + 1) for k, (o, v) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"vocabulary_bytes": 200, "tile_sources": 2}])
def test_divergence_against_brute_force(spark, options):
    rng = random.Random(5)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Élan", "ÉLAN", "naïve", "日本", "😀x"]
    rows = []
    for i in range(150):
        lang, source = rng.choice(["en", "en", "de", None, "x y"]), rng.choice(["a", "a", "b", "c", None, "é"])
        low = ord(source[0]) % 40 if source else 0
        words = [vocab[min(len(vocab) - 1, low + int(rng.expovariate(0.05)))] for _ in range(rng.randrange(0, 60))]
        rows.append((lang, source, rng.choice([" ", "-", "\x00", "@1"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words)))
    rows += [("fr", "a", "only once here"), ("fr", "b", None), ("en", "none", ""), ("en", "none", None), ("en", "a", "long " * 20000), rows[0], rows[0]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, c int").repartition(4)
    assert sorted(tuple(r) for r in source_divergence(docs, **options).collect()) == brute_divergence(rows)


def test_divergence_many_models_and_empty(spark):
    docs = spark.createDataFrame([("en", "a", "one two three"), ("en", "b", "two three one"), ("en", "b", "three one two")], "lang string, source string, text string")
    counts, sizes = divergence.term_counts(docs, 3, 1)
    assert {(r.source, r.term): r.c for r in counts.collect()} == {(s, t): n for s, n in (("a", 1), ("b", 2)) for t in ("one", "two", "three")}
    assert sizes.collect() == [("en", 3)]
    assert source_divergence(docs.limit(0)).collect() == []


def test_divergence_folds_before_vectors(spark, monkeypatch):
    """Occurrences are vectorised by the bits of their counts, not one by one; small folds, bags and ranks give the same rows."""
    rows = [("en", f"s{i % 3}", " ".join(["the"] * (i * 37 % 300) + [f"w{chr(97 + i % 7)}", f"v{chr(97 + i % 11)}", "of"] * (i % 5))) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(2)
    many = sum(len(text.split()) for _, _, text in rows)
    dealt = divergence.dealt_terms(divergence.bags(docs), 2).select(F.explode("terms"), "shift")
    held = dealt.agg(F.count(F.lit(1)), F.sum(F.expr("shiftleft(1L, shift)"))).first()
    assert held[1] == many and held[0] < many / 20
    for name, size in (("SUM_TERMS", 5), ("BAG_TOKENS", 50), ("BAG_TERMS", 3), ("BAG_ROWS", 2), ("SUM_CELLS", 10), ("RANK_ROWS", 4)):
        monkeypatch.setattr(divergence, name, size)
    assert sorted(tuple(r) for r in source_divergence(docs, term_ranks=2).collect()) == brute_divergence(rows, ranks=2)


def test_divergence_folds_bounded_bytes(spark, monkeypatch):
    """A task folds a split's terms by number, each once a split, and hands a fold on when its terms' bytes are many, however few they are."""
    lengths, coded = divergence.terms_of([b" The the-THE ", None, b"1", "né the".encode()])
    assert [[t for t in coded.to_pylist()[end - n : end] if t] for n, end in zip(lengths, lengths.cumsum())] == [["the"] * 3, [], [], ["né", "the"]]
    assert sorted(coded.dictionary.to_pylist()) == ["", "né", "the"]
    rows = [("en", f"s{i % 2}", " ".join(["日本" * 40 + chr(97 + i % 5), "word"] * (1 + i % 3)) if i % 7 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    assert divergence.bags(docs).count() == 3
    monkeypatch.setattr(divergence, "BAG_BYTES", 500)
    monkeypatch.setattr(divergence, "SPLIT_BYTES", 100)
    assert divergence.bags(docs).count() > 20
    assert sorted(tuple(r) for r in source_divergence(docs).collect()) == brute_divergence(rows)


def test_divergence_shares_are_exact(spark):
    edge = (1 << 63) // divergence.UNIT
    rows = [(c, c + more, v) for c in (0, 1, 7, edge - 2, edge - 1, edge, edge + 1, 10**15, 4 * 10**18) for more in (0, 1, 10**18) for v in (1, 12345)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    found = df.select("c", "n", "v", divergence.share_of(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(p == 1 + divergence.UNIT * (c + 1) // (n + v) for c, n, v, p in found.collect())
    plain = df.where("c < 10").select(divergence.share_of(F.lit(0), F.col("n"), F.col("v")).alias("p"), F.col("n") + F.col("v"))
    assert all(p == 1 + divergence.UNIT // d for p, d in plain.collect())
