"""Text operators against brute force, round trips and held-out rows."""

import base64
import bz2
import gzip
import hashlib
import json
import lzma
import random
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from softdeps.llm.chat import canonical, escape, format_chat, read_chat, turn_records, unescape
from softdeps.llm.mixing import mix, mix_counts, source_targets
from softdeps.llm.ngram_join import Shingles, jaccard_components, mixed
from softdeps.llm.packing import hilbert_keys, pack_by_curve
from softdeps.llm.queries import tokenizer_path
from softdeps.llm.secret_scan import ACCESS, ASSIGN, HEX, find_secrets, redact_secrets, scan
from softdeps.llm import suffix_dedup
from softdeps.llm.sentence_spans import drop_repeated_sentences, runs, sentences
from softdeps.llm.common import more_components
from softdeps.llm.suffix_dedup import drop_repeated_strings, suffix_array
from softdeps.llm.toxicity import GRAMMAR, Lexicon, compose, negation, reported, score_toxicity

VOCAB = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", "", ".", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def copies(spark):
    """Documents with exact copies, near copies and shared passages."""
    rng, rows = random.Random(4), []
    passage = prose(rng, 120)
    for i in range(60):
        text = prose(rng, rng.randrange(5, 200))
        if i % 6 == 0:
            text += " " + passage + " " + prose(rng, 20)
        rows.append(text)
        for _ in range(rng.choice([0, 0, 1, 3])):
            words = text.split(" ")
            for _ in range(rng.choice([0, 1, 2, 8])):
                words[rng.randrange(len(words))] = rng.choice(VOCAB)
            rows.append(" ".join(words))
    rows += ["De " * 900, "De " * 400]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(7), rows


def test_secrets_layers():
    secret = "password=abcdefgh12"
    inner = base64.b64encode(secret.encode()).decode()
    for text in (quote(secret, safe=""), quote(quote(secret, safe=""), safe=""), "".join(f"\\u{ord(c):04x}" for c in secret), inner):
        assert [(s, e) for s, k, e in scan(f"a {text} z")[1] if k == 0], text
    twice = base64.b64encode(gzip.compress(base64.b64encode(gzip.compress(secret.encode())))).decode()
    base, spans, layers, cut = scan(f"see {twice} end")
    assert not base and spans == [(4, 0, 4 + len(twice))] and layers >= 2 and not cut
    assert scan("see " + quote(secret, safe="") + " end")[1] == [(4, 0, 4 + len(quote(secret, safe="")))]
    assert scan("%41%")[1] == [] and scan("\\u{110000}")[1] == []


def test_secrets_layers_at_every_place():
    secret = "password=abcdefgh12"
    inner = base64.b64encode(secret.encode()).decode()
    packed = base64.b64encode(gzip.compress(secret.encode())).decode()
    outer = base64.b64encode(f"{inner} {inner}".encode()).decode()
    for blob, each in ((inner, 1), (packed, 1), (quote(secret, safe=""), 1), (outer, 2)):
        base, spans, layers, cut = scan(f"one {blob} two\n{blob} three")
        at = [4, 4 + len(blob) + 5]
        assert not base and len(spans) == 2 * each and layers and not cut
        assert all(sum(a <= s and e <= a + len(blob) for s, _, e in spans) == each for a in at), blob
    # by two routes: in the text and inside another blob
    spans = scan(f"{inner} and {base64.b64encode(('x ' + inner).encode()).decode()}")[1]
    assert len(spans) == 2 and spans[1][0] > len(inner)
    assert scan("%" + "25" * 3000 + "41")[2] >= 3000


def test_secrets_wrapped_glued_and_in_later_members():
    secret, b64 = "password=abcdefgh12", lambda raw: base64.b64encode(raw).decode()
    filler = " ".join(str(i) for i in range(60)).encode()
    for pack in (gzip.compress, bz2.compress, lzma.compress):
        blob = b64(pack(b"nothing") + pack(filler) + pack(secret.encode()))
        assert scan(f"see {blob} end")[1:] == ([(4, 0, 4 + len(blob))], 1, 0)
    for raw in (filler[:50] + b" " + secret.encode() + b" " + filler, gzip.compress(random.Random(3).randbytes(200).hex().encode()[:31] + filler + b" " + secret.encode())):
        lines = base64.encodebytes(raw).decode()
        spans = [x for x in scan(f"see\n\n{lines}\nend")[1] if x[1] == 0]
        assert len(lines.split()) > 1 and len(spans) == 1 and 5 <= spans[0][0] < spans[0][2] <= 5 + len(lines)
    for before in ("https://host/cb/", "a-", "ab_", "abc/", "path/to/"):
        for blob in (b64(secret.encode()), b64(gzip.compress(secret.encode()))):
            spans = scan(f"{before}{blob} end")[1]
            assert any(k == 0 and len(before) - 4 < s <= len(before) and e == len(before) + len(blob) for s, k, e in spans), (before, blob)
    assert scan("an extraordinarilylongword\nand others/follow-here_too\nto the end")[1:] == ([], 0, 0)


def test_secrets_base_is_the_patterns(spark, odd, empty):
    rng = random.Random(1)
    parts = ["token", "=", " ", "'", "AKIA", "ABCDEF0123456789", "deadbeef" * 4, "secret", ":", "api_key", "x", "ſecret", "K", "0" * 33, "password=short"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        want = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
        base, spans, *_ = scan(text)
        assert base == sorted(want) and set(base) <= set(spans)
    found = find_secrets(odd)
    assert found.count() == odd.count() and found.where("spans <> ''").count() == 0
    assert found.first()["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert find_secrets(empty).count() == 0
    hidden = redact_secrets(spark.createDataFrame([(1, "my token=abcdefghijk ok"), (2, None)], "doc_id long, text string"))
    assert sorted(r["text"] or "" for r in hidden.collect()) == ["", "my [SECRET] ok"]


def test_packing(spark, odd, empty, copies):
    from tokenizers import Tokenizer

    docs = odd.select("doc_id", "text").unionAll(copies[0].withColumn("doc_id", F.col("doc_id") + 100))
    rows = pack_by_curve(docs, tokenizer_path(), length=64).collect()
    tokenizer, pieces, sequences = Tokenizer.from_file(tokenizer_path()), {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
    for lengths in sequences.values():
        ends = np.cumsum([n for _, n in sorted(lengths)])
        assert [o for o, _ in sorted(lengths)] == [0, *ends[:-1]] and ends[-1] <= 64 and ends[-1] & (ends[-1] - 1) == 0
    for doc_id, text in docs.dropDuplicates(["doc_id"]).collect():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        got = sorted(pieces[doc_id], key=lambda r: r["start"])
        times = 2 if doc_id == 8 else 1
        assert sum(r["length"] for r in got) == times * len(ids) and got[0]["doc_tokens"] == len(ids)
        if times == 1:
            assert np.frombuffer(b"".join(r["ids"] for r in got), "<u4").tolist() == ids
    assert pack_by_curve(empty, tokenizer_path()).count() == 0


def test_hilbert_neighbours():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_mix(spark, odd, empty, copies):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(40), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    counted = mix_counts(docs).collect()
    size = Counter()
    for _, text, source in rows:
        size[source] += len(text.split())
    order = sorted((s for s in size if s), key=lambda s: s) + [None]
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        want = 2 * size[s] if s in full else level * weight[s]
        mine = [r for r in counted if r["source"] == s]
        assert all(abs(r["target"] - want) < 1e-6 and r["source_size"] == size[s] and 0 <= r["copies"] <= 2 for r in mine)
        assert abs(sum(r["copies"] * r["size"] for r in mine) - want) <= 40
    assert sorted(map(tuple, counted), key=str) == sorted(map(tuple, mix_counts(docs).collect()), key=str)
    assert mix(docs).count() == sum(r["copies"] for r in counted) and mix(docs).columns == docs.columns
    assert mix_counts(odd).count() == odd.count() and mix(empty).count() == 0
    assert source_targets(spark.createDataFrame([("a", 0)], "source string, source_size long")).first()["target"] == 0


def test_mix_salted(spark, monkeypatch):
    rows = [(i, "w w w", "a") for i in range(500)] + [(500 + i, "w " * i, "b") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr("softdeps.llm.mixing.BUCKET_ROWS", 50)
    got = mix_counts(docs).where("source = 'a'").agg(F.sum(F.col("copies") * F.col("size")), F.first("target"), F.count("*")).first()
    assert abs(got[0] - got[1]) <= 3 and got[2] == 500


def test_mix_order_at_every_size(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i if i % 50 else None, "w " * (3 if i < 500 else i % 9), rng.choice(["a", "a", "b", None])) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    taken = lambda: sorted(((r["doc_id"], r["source"], r["size"], r["copies"]) for r in mix_counts(docs).collect()), key=str)
    want = taken()
    monkeypatch.setattr("softdeps.llm.mixing.BUCKET_ROWS", 50)
    assert taken() == want


def test_chat_round_trip(spark):
    rng = random.Random(3)
    bits = ["<", "</s>", "[INST]", "\\", "\n", "\\0", "<|im_end|>", "ok", "[", "é", "<<SYS>>", "|>", "<|im_start|>user"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        assert unescape(escape(text)) == text and not any(c in escape(text) for c in ("<|im_end|>", "</s>", "[INST]", "<<SYS>>"))
    rows = [(c, t, rng.choice(["user", "assistant", None, "odd\nrole"]), rng.choice([None, "", *bits])) for c in range(30) for t in range(c % 5)] + [(9, 1, "user", "<s>")]
    got = {r["conv_id"]: r for r in read_chat(format_chat(turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    for c, r in got.items():
        mine = sorted(((t, role or "", text or "") for i, t, role, text in rows if i == c), key=lambda x: (x[0], x[1], escape(x[2])))
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in mine).encode()).hexdigest()
        said = "".join(text for _, role, text in mine if role == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_layouts(spark):
    want = [("system", "S"), ("user", "Q"), ("assistant", "A")]
    for record in (
        {"system": "S", "prompt": "Q", "response": "A"},
        {"system": "S", "conversations": [{"from": "human", "value": "Q"}, {"from": "gpt", "value": "A"}]},
        {"messages": [{"role": r, "content": t} for r, t in want]},
    ):
        assert canonical(record) == want
    assert canonical({"instruction": "Q", "input": "I", "output": None}) == [("user", "Q\n\nI"), ("assistant", "")]
    assert canonical({"odd": 1}) is None
    records = spark.createDataFrame([(1, 0, json.dumps({"odd": 1})), (2, 0, "no json"), (3, 0, None)], "conv_id long, turn long, record string")
    assert {r["role"] for r in format_chat(records).collect()} == {"unknown"}
    assert read_chat(format_chat(records.limit(0))).count() == 0


def test_sentence_spans(copies, odd, empty):
    docs, rows = copies
    seen, first = {}, set()
    for i, text in enumerate(rows):
        for a, b, key in runs(text.encode(), 2, 20):
            seen.setdefault(key, (i, a))
            if seen[key] != (i, a):
                first.update((i, k) for k in range(a, b + 1))
    for r in drop_repeated_sentences(docs).collect():
        cut, raw = sentences(rows[r["doc_id"]].encode()), rows[r["doc_id"]].encode()
        assert b"".join(raw[s:e] for s, e, _ in cut) == raw
        assert r["text"].encode() == b"".join(raw[s:e] for k, (s, e, _) in enumerate(cut) if (r["doc_id"], k) not in first)
    got = drop_repeated_sentences(odd)
    assert got.count() == odd.count() and "score" in got.columns and drop_repeated_sentences(empty).count() == 0


def test_sentence_runs_of_any_length(spark):
    rng = random.Random(11)
    said = lambda n: " ".join(f"{rng.choice(VOCAB)}{rng.randrange(99)}" for _ in range(n))
    tail = " ".join(said(n) + "." for n in (25 - 1, 10, 9))
    unmarked = said(50)  # no sentence ends in it
    texts = [f"{said(30)}. {tail} {said(8)}.", f"{said(7)}. {tail} {said(8)}. {said(9)}.", f"{said(3)} {unmarked} {said(30)}", f"{said(14)} {unmarked} {said(26)}"]
    texts += [". ".join(rng.choice(["a b c", "d e", "f g h i j k", "l m n o p q r"]) for _ in range(60)) for _ in range(4)]
    every = {}
    for i, text in enumerate(texts):
        cut = sentences(text.encode())
        for a in range(len(cut)):
            for b in range(a + 1, len(cut)):
                words = [w for s in cut[a : b + 1] for w in s[2]]
                if len(words) >= 20:
                    every.setdefault(tuple(words), []).append((i, a, b))
    gone = {(i, k) for places in every.values() for i, a, b in places if (i, a) != places[0][:2] for k in range(a, b + 1)}
    got = {r["doc_id"]: r for r in drop_repeated_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, text in enumerate(texts):
        raw = text.encode()
        assert got[i]["text"].encode() == b"".join(raw[s:e] for k, (s, e, _) in enumerate(sentences(raw)) if (i, k) not in gone)
    assert tail not in got[1]["text"] and tail.split(". ")[-1] not in got[1]["text"] and tail in got[0]["text"]
    assert got[3]["n_removed_sentences"] >= 2 and got[2]["n_removed"] == 0


def test_sentence_spans_without_ids(spark):
    texts = ["One two three. " * 12 + "Short.", "Other words stand here. Nothing repeats.", "x.", None]
    rows = [(None, t) for t in texts] + [(7, t) for t in texts[:3]]
    got = drop_repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert len(kept) == 7 and all((i, t) in kept for i in (None, 7) for t in texts[1:3]) and (None, None) in kept


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice(b"abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(60)))
        assert suffix_array(data, 100).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("shard", [1 << 19, 600])
def test_repeated_strings(copies, odd, empty, shard):
    docs, rows = copies
    counts = Counter(t.encode()[i : i + 120] for t in rows for i in range(len(t.encode()) - 119))
    for r in drop_repeated_strings(docs, length=120, shard_bytes=shard).collect():
        raw = rows[r["doc_id"]].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 119):
            if counts[raw[i : i + 120]] > 1:
                gone[i : i + 120] = b"\1" * 120
        assert r["kept"] == bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        assert r["n_spans"] == sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
    if shard > 600:
        assert drop_repeated_strings(odd).count() == odd.count() and drop_repeated_strings(empty).count() == 0


def test_one_passage_in_every_text(spark):
    """A hot anchor is halved down to single windows: ends that differ, ends that are shared by some, a period, and copies."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, tails = word(130), [word(30) for _ in range(3)]
    rows = [word(rng.randrange(40)) + passage + rng.choice(tails)[: rng.randrange(31)] + word(rng.randrange(40)) for _ in range(60)]
    rows += [rows[0], rows[1], "xy" * 150, "z" + passage[5:], passage[:119]]
    counts = Counter(t[i : i + 120] for t in rows for i in range(len(t) - 119))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in drop_repeated_strings(docs, length=120, shard_bytes=300).collect():
        text, gone = rows[r["doc_id"]], set()
        for i in range(len(text) - 119):
            if counts[text[i : i + 120]] > 1:
                gone.update(range(i, i + 120))
        assert r["kept"].decode() == "".join(c for k, c in enumerate(text) if k not in gone)


def test_large_groups_need_no_shuffle(spark, copies, monkeypatch):
    """Contexts learn by a broadcast whether their anchor's group is too large for a shard, whatever the sizes that Spark expects."""
    plans, whole = [], suffix_dedup.map_batches

    def kept(df, task, schema, *rest):
        if schema == suffix_dedup.HALVES:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, task, schema, *rest)

    monkeypatch.setattr(suffix_dedup, "map_batches", kept)
    monkeypatch.setattr(suffix_dedup, "stage", lambda df, label: df.localCheckpoint())  # no file sizes: of unknown size, too large to broadcast
    drop_repeated_strings(copies[0], length=120, shard_bytes=600)
    assert plans and all("BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan for plan in plans)


def test_jaccard(copies, odd, empty):
    docs, rows = copies

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    def brute(texts):
        sets, parent = [shingles(t) for t in texts], list(range(len(texts)))
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                    lo, hi = sorted((parent[i], parent[j]))
                    parent = [lo if p == hi else p for p in parent]
        return {i: (len(s), parent[i]) for i, s in enumerate(sets)}

    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()} == want
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(odd).collect()}
    assert got[7] == 6 and got[0] == 0 and got[2] == 2 and got[3] == 3 and None in got
    assert jaccard_components(empty).count() == 0


def test_jaccard_links_through_rows_without_ids(spark):
    words = [f"w{i}" for i in range(66)]
    chain = [" ".join(words[: 60 + 3 * k]) for k in range(3)]  # neighbours link, the ends don't
    ids = lambda *named: {r["doc_id"]: r["component_id"] for r in jaccard_components(spark.createDataFrame(list(zip(named, chain)), "doc_id long, text string")).collect()}
    assert ids(1, 3, 2) == {1: 1, 3: 1, 2: 1} and ids(1, None, 2) == {1: 1, None: 1, 2: 1} and ids(None, 7, None) == {None: 7, 7: 7}
    other = spark.createDataFrame([(None, t) for t in [*chain, "a b c d", "e f g h", None]], "doc_id long, text string")
    assert [r["component_id"] for r in jaccard_components(other).collect()] == [None] * 6


def test_more_components(spark):
    rng, known, edges, parent = random.Random(3), None, [], list(range(200))
    for _ in range(4):
        new = [(rng.randrange(200), rng.randrange(200)) for _ in range(40)]
        edges += new
        known = more_components(known, spark.createDataFrame(new, "a long, b long"))
        for a, b in new:
            lo, hi = sorted((parent[a], parent[b]))
            parent = [lo if p == hi else p for p in parent]
        touched = {x for e in edges if e[0] != e[1] for x in e}
        got = {r["node"]: r["component"] for r in known.collect()}
        assert {n: c for n, c in got.items()} == {n: parent[n] for n in touched} and known.count() == len(touched)
    assert more_components(known, spark.createDataFrame([], "a long, b long")).count() == len(touched)


def test_jaccard_last_center(spark, monkeypatch):
    """One block of more than six documents that don't link, but for the fifth smallest set and a later one."""
    rng = random.Random(8)
    words = lambda n: [f"{rng.choice(VOCAB)}x{rng.randrange(999)}" for _ in range(n)]

    def node(text):  # as the operator numbers sets
        s = Shingles().of(text.encode())
        return int(mixed(np.cumsum(mixed(s))[-1:] + np.uint64(len(s))).view(np.int64)[0])

    texts = sorted((" ".join(words(60)) for _ in range(10)), key=node)
    twin = next(t for t in (" ".join([*texts[4].split()[:-1], *words(1)]) for _ in range(1000)) if node(t) > node(texts[4]))
    monkeypatch.setattr("softdeps.llm.ngram_join.block_keys", lambda *_: [1])
    docs = spark.createDataFrame(list(enumerate([*texts, twin])), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()} == {**{i: i for i in range(10)}, 10: 4}


def test_grammar():
    lexicon = Lexicon({"fool": ("I", 3.0), "you": ("U", 0.0), "not": ("N", 0.0), "said": ("R", 0.0)}, {"lowei": 4.0})
    plain = lexicon.score("the fool")
    assert lexicon.score("you fool") > plain > lexicon.score("he said the fool") > lexicon.score("not a fool") >= 0
    assert lexicon.score("not. fool") == plain and lexicon.score("loweitum") == 4.0 and lexicon.score("") == 0
    both = compose(negation(), reported())
    assert both[0, "O"][2] == 0 and len(GRAMMAR) % 6 == 0


def test_toxicity_held_out(spark, odd, empty):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = score_toxicity(docs.select("doc_id", "text"), labels)
    m = scored.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in m}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9 and n.get((0, 1), 0) / n[0, 0] < 0.02
    got = score_toxicity(odd, labels)
    assert got.count() == odd.count() and got.where("score between 0 and 1").count() == odd.count()
    assert score_toxicity(empty, labels).count() == 0
    assert score_toxicity(odd, labels.limit(0)).where("predicted = 1").count() == 0


def test_mix_keeps_columns_named_like_its_figures(spark):
    rows = [(i, "a b c", "s", 100 + i, "t", 7) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target string, copies int")
    taken = mix(docs).collect()
    assert len(taken) >= 8 and {tuple(r) for r in taken} <= set(rows)
