"""The registered queries of the operators, over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.llm import byte_bpe, chat, collocations, contamination, digest_runs, disclosure, packing, prefix_trie, separators, simhash, toxicity, url_rules, wavelet, work

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    work.ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judged(_table(spark, folder, "pages"), _table(spark, folder, "labels"))


def op2_wavelet(spark: SparkSession, folder: str) -> DataFrame:
    read = wavelet.read_shards(wavelet.write_shards(_table(spark, folder, "documents")))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_groups(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(_table(spark, folder, "documents"))
    return packed.places.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_contamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = contamination.annotated(docs, _table(spark, folder, "benchmark"), "found")
    items = F.array_join(F.array_sort(F.transform("found.items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        contamination.contaminated("found").alias("contaminated"),
    )


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return separators.counted(_table(spark, folder, "documents")).select("doc_id", "n_tokens")


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    same = "conv_id bigint, turn bigint, role string, text string"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    given = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.formatted(given.to(spark.createDataFrame([], same).schema).unionByName(more))
    read = out.select(
        "conv_id",
        chat.turns_of(F.col("formatted")).alias("turns"),
        chat.learned_of(F.col("formatted"), F.col("loss_mask")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    found = disclosure.personal_data(_table(spark, folder, "documents"))
    names = F.array(*[F.lit(k) for k in (*disclosure.KINDS, disclosure.TERM, disclosure.TERM)])

    def joined(spans: Column) -> Column:
        written = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, written), ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    placed = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    ordered = F.array_sort(F.transform(F.concat("spans", "term_spans"), placed))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(disclosure.KINDS)],
        F.sha2(joined(F.col("spans")), 256).alias("base_sha256"),
        joined(ordered).alias("spans"),
    )


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = digest_runs.exact_groups(_table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered(_table(spark, folder, "conversations"))))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = byte_bpe.decode(byte_bpe.encode(_table(spark, folder, "documents")))
    return found.select(
        "doc_id",
        byte_bpe.n_tokens("ids").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_url_rules": op1_url_rules,
    "op2_wavelet": op2_wavelet,
    "op3_toxicity": op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_contamination": op6_contamination,
    "op7_token_counts": op7_token_counts,
    "op8_chat": op8_chat,
    "op9_disclosure": op9_disclosure,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_byte_bpe": op13_byte_bpe,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

def _sql_escaped(text: str) -> str:
    """Code points of a text with a backslash before each of its own and behind the start of each control string."""
    count = lambda mark: f"(length({text}) - length(replace({text}, '{mark}', ''))) // {len(mark)}"
    doubled = f"length({text}) - length(regexp_replace({text}, '<+', '<', 'g'))"
    return " + ".join([f"length({text})", *map(count, ("\\", "<|", "<s>", "</s>", "[INST]", "[/INST]")), doubled])


ORACLES: dict[str, str] = {
    "op8_chat": f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_sql_escaped("text")} + CASE WHEN opens
    THEN length('<|im_start|>') + {_sql_escaped("role")} + length('<|im_sep|>') + length('<|im_end|>') + 1
    ELSE length('<|im_join|>') END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
""",
    "op6_contamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS words
  FROM (SELECT item_id, w, least(len(w), 13) AS size FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i,
    unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS words
  FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows x ON p.words = x.words AND p.size = x.size),
covered AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op10_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM t WINDOW same AS (PARTITION BY text_sha256)
""",
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 20 AS base, count(*) AS n FROM t GROUP BY c),
crc AS (
  SELECT c, base, n, list_reduce(list_concat([4294967295::UBIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::UBIGINT)),
    lambda x, y: list_reduce(list_concat([xor(x, y)], list_transform(range(0, 8), lambda k: 0::UBIGINT)),
      lambda v, w: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS state FROM convs),
heads AS (SELECT c, base, (xor(state, 4294967295::UBIGINT) % 4)::BIGINT AS h FROM crc),
taken AS (SELECT h.*, least(h.h, coalesce(b.n, 0)) AS taken FROM heads h LEFT JOIN convs b ON b.c = h.base),
rebuilt AS (
  SELECT x.c, place + 1 AS depth, role, text FROM taken x JOIN t ON t.c = x.base AND place < x.h
  UNION ALL SELECT x.c, place - x.h + x.taken + 1, role, text FROM taken x JOIN t ON t.c = x.c AND place >= x.h),
prefixes AS (
  SELECT c, depth, text,
    sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY depth)) AS node FROM rebuilt
  UNION ALL SELECT c, 0, '', '' FROM taken),
parents AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY c) AS deepest FROM prefixes),
nodes AS (
  SELECT node, depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs,
    any_value(len(regexp_extract_all(text, '[^ 	-
]+'))) AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = deepest), '')) AS ends_sha256
  FROM parents GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
subtrees AS (
  SELECT p.node, sum((v.n_convs - 1) * v.words)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM nodes v JOIN prefixes p ON p.c = v.conv_id AND p.depth <= v.depth LEFT JOIN children k ON k.node = v.node GROUP BY p.node)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN children USING (node) JOIN subtrees USING (node) LEFT JOIN nodes up ON up.node = n.parent AND n.depth > 0
""",
    "op12_collocations": rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scores AS (
  SELECT c.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS around FROM c WHERE size = 3),
around AS (SELECT lang, phrase, max(around) AS around FROM inner_phrases GROUP BY ALL),
ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest l LEFT JOIN around USING (lang, phrase) WHERE size = 3 OR around IS NULL OR 100 * around < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
}
