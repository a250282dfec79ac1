"""SQL twins (DuckDB) of the operators' queries; operators without one are tested against brute force, a round trip or held-out rows."""

SIZED = r"""
sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS r FROM totals),
weighed AS (SELECT source, source_size, 2 * source_size AS room, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ranked),
-- sources fill up in the order of room to weight; a level is sound when it fits all that are left
ordered AS (SELECT *, row_number() OVER (ORDER BY room * 1.0 / w, source) AS k FROM weighed),
levels AS (
  SELECT k, room, w, (1.5 * sum(source_size) OVER () - coalesce(sum(room) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM ordered),
level AS (SELECT arg_min(level, k) AS v FROM levels WHERE level * w <= room),
targets AS (SELECT source, source_size, CASE WHEN v * w > room THEN room::DOUBLE ELSE v * w END AS target FROM weighed, level)"""

# A turn's escaped text has one more character for each backslash and control string.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPES = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) / {len(c)}" for c in ("\\", *CONTROLS)).replace(" / ", " // ")

# The sets of op10: words in lower case (A-Z alone), distinct runs of three, or the whole sequence if shorter.
SHINGLES = r"""
split_ AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM split_),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS both_ FROM flat a
  JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met WHERE 100 * both_ >= 90 * (an + bn - both_)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN either e ON r.other = e.a),
grouped AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)"""

# A checksum bit by bit: a byte is mixed in by exclusive or, and each -1 after it shifts one bit out.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1),
  lambda i: list_concat([ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT], list_transform(range(8), lambda j: -1::BIGINT))))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


def _levels(name: str, levels: int) -> str:
    """``name0(tree, i, h)`` rolled up: ``name1`` and so on are the levels above, ``name0s`` and so on each node's siblings; a lone node stays itself."""
    parts = []
    for k in range(levels):
        parts.append(f"""{name}{k}n AS (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM {name}{k}),
{name}{k}s AS (SELECT tree, i, m > 1 AS up, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}n WINDOW w AS (PARTITION BY tree, i // 16 ORDER BY i)),
{name}{k + 1} AS (SELECT tree, i // 16 AS i, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
  FROM {name}{k}n GROUP BY tree, i // 16)""")
    return ",\n".join(parts)


def _climb(names: list[tuple[str, str, str]]) -> tuple[str, str, str]:
    """Joins, the siblings' text and the folded root along levels ``(table, tree, index)``."""
    joins, proof, fold = [], [], "tampered"
    for j, (table, tree, index) in enumerate(names):
        joins.append(f"JOIN {table} j{j} ON j{j}.tree = {tree} AND j{j}.i = {index}")
        proof.append(f"CASE WHEN j{j}.up THEN j{j}.l || j{j}.r ELSE '' END")
        fold = f"CASE WHEN j{j}.up THEN sha256(j{j}.l || {fold} || j{j}.r) ELSE {fold} END"
    return "\n".join(joins), " || ".join(proof), fold


# Levels that the twin of op12 unrolls: enough for 16^4 documents of a source and 16^3 sources.
LEAF_LEVELS, SOURCE_LEVELS = 4, 3
_CLIMBED = _climb([(f"d{k}s", "x.tree", f"x.i // {16**k}") for k in range(LEAF_LEVELS)] + [(f"t{k}s", "0", f"y.i // {16**k}") for k in range(SOURCE_LEVELS)])

# The terms of op13 by language and source.
TERMS = r"""
cleaned AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT d, lang, source, unnest(w) AS term FROM cleaned),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
sized AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM cleaned),
totals AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
whole AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM counts GROUP BY lang, term),
wholes AS (SELECT lang, sum(n)::HUGEINT AS n FROM totals GROUP BY lang),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (n + v) AS p
  FROM totals JOIN sized USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (c + 1) // (n + v) AS q FROM whole JOIN wholes USING (lang) JOIN sized USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
blank AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM sized)),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
  FROM (FROM pair UNION ALL FROM blank UNION ALL FROM term))"""

USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES = {
    "op1_itq_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND {USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
grouped AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id,
  coalesce(component_id, e.vec_id) IS NOT DISTINCT FROM e.vec_id AS kept
FROM embeddings e LEFT JOIN grouped USING (vec_id) LEFT JOIN counted USING (vec_id)""",
    "op3_cover_tree": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {USABLE}),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.e, r.e)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.e) = len(r.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op5_chat_format": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + {ESCAPES} + {len("<|im_start|>") + 1 + len("<|im_end|>") + 1})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op10_ngram_join": f"""
WITH RECURSIVE {SHINGLES}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN grouped USING (doc_id)""",
    "op9_source_mix": rf"""
WITH {SIZED},
rates AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size::DOUBLE END AS rate,
  ('0x' || substr(md5('mix:' || CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE AS u FROM targets),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id)::DOUBLE AS place FROM sized)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((floor(rate * place + u) - floor(rate * (place - 1) + u))::BIGINT * size)::BIGINT AS taken
FROM placed p JOIN rates r ON p.source IS NOT DISTINCT FROM r.source""",
    "op11_warc_bundles": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
least AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN least USING (payload_digest)""",
    "op12_merkle_manifest": f"""
WITH leaves AS (
  SELECT doc_id, 's' || source AS named, {_leaf("text")} AS h,
    {_leaf(f"CASE WHEN {CRC32} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")} AS tampered
  FROM documents),
keyed AS (SELECT doc_id, coalesce(named, 'n') AS tree, h, tampered FROM leaves),
x AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS LAST, h) - 1 AS i FROM keyed),
d0 AS (SELECT tree, i, h FROM x),
{_levels("d", LEAF_LEVELS)},
y AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM d{LEAF_LEVELS}),
t0 AS (SELECT 0 AS tree, i, h FROM y),
{_levels("t", SOURCE_LEVELS)},
found AS (
  SELECT doc_id, x.h AS leaf, y.h AS subroot, t.h AS root, sha256({_CLIMBED[1]}) AS proof_sha256, {_CLIMBED[2]} AS folded_root
  FROM x JOIN y ON x.tree = y.tree CROSS JOIN t{SOURCE_LEVELS} t
  {_CLIMBED[0]})
SELECT *, folded_root = root AS verified FROM found""",
    "op13_source_divergence": f"""
WITH {TERMS}
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
}
