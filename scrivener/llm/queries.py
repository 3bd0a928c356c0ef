"""The opN_<name> queries and their SQL, for `__spark_entry__`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_table import digests, encode_decode

    return digests(encode_decode(spread(table(spark, sf_dir, "documents")), piece_model()))


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards draw of each document; `shards` and `blocks` say which of them and of which
    blocks of its source's line, by pass."""
    from . import mixing

    words = F.aggregate("draws", F.lit(0).cast("long"), lambda n, d: n + d["words"])
    of = lambda name: F.transform("draws", lambda d: d[name])
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", words.alias("taken"), of("shard").alias("shards"), of("block").alias("blocks"))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 12 shards by source, as uneven as the sources are, to 16 shards of equal bytes: the texts are
    rewritten into the new shards' files and read back from them."""
    from . import resharding

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = resharding.resharded(docs, F.pmod(F.xxhash64("source"), F.lit(12)), 16)
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@query
def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .iso_media import UNIT, text_media

    media = text_media(spread(table(spark, sf_dir, "documents")))
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


@query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import edited_pairs

    return edited_pairs(table(spark, sf_dir, "documents"))


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings."""
    from .chat_format import digests, examples

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(examples(rows))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fold, score, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(spread(docs), model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract_pages

    found = extract_pages(spread(table(spark, sf_dir, "pages")))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join

    return join(spread(table(spark, sf_dir, "documents")))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches of inserts with the count of words for both versions, a redelivery
    of the first, a batch that revises every document's count of pieces, one that deletes a
    quarter of the documents, a compaction, and one that puts them back."""
    from .common import scratch, stored
    from .token_counts import KEYS, Rollup, count_pieces, revised, signed

    counts = stored(count_pieces(spread(table(spark, sf_dir, "documents")), piece_model()), "token-counts")
    rollup = Rollup(spark, scratch(spark, "token-rollup"))

    def of(rows: DataFrame, version: str, column: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(column).alias("n_tokens"))

    for k in (0, 1, 2, 3, 0):
        part = counts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k)
        rollup.commit(f"load-{k}", signed(of(part, "words_v1", "words").unionByName(of(part, "piece_bpe_32k", "words")), 1))
    rollup.commit("revise-pieces", revised(of(counts, "piece_bpe_32k", "words"), of(counts, "piece_bpe_32k", "pieces")))
    part = counts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 2)
    gone = of(part, "words_v1", "words").unionByName(of(part, "piece_bpe_32k", "pieces"))
    rollup.commit("take-out", signed(gone, -1))
    rollup.compact()
    rollup.commit("put-back", signed(gone, 1))
    return rollup.totals().select(*KEYS, "n_docs", "n_tokens")


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit, masked

    return audit(masked(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


@query
def op12_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minmax_dedup import near_duplicates

    return near_duplicates(spread(table(spark, sf_dir, "documents")))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(spread(table(spark, sf_dir, "documents").select("text", "lang")))


_ESCAPED = r"regexp_replace({}, '(<</|<<|</|<|\[/|\[)(\\*)(\||s>|INST\]|SYS>>)', '\1\2\\\3', 'g')"

ORACLES["op7_chat_formatting"] = f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
 t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
 12 + length({_ESCAPED.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + 1 + length({_ESCAPED.format("text")}) + 11 AS c FROM r),
 p AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM t)
 SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(prefix) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars FROM p GROUP BY conv_id"""

ORACLES["op3_ngram_jaccard"] = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
 e AS (SELECT doc_id, unnest(s) AS t FROM g), n AS (SELECT doc_id, len(s) AS n FROM g),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 0.000000001),
 reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
 k AS (SELECT a, min(b) AS b FROM reach GROUP BY 1), m AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
 SELECT doc_id, coalesce(least(doc_id, k.b), doc_id) AS class_id, coalesce(m.n, 0) AS n_links FROM documents LEFT JOIN k ON k.a = doc_id LEFT JOIN m ON m.a = doc_id"""

_FAILS = {
    "A": "len(w) < 50",
    "B": "100 * len(list_distinct(w)) < 65 * len(w)",
    "C": "100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t)",
    "D": "regexp_matches(t, '[#$%&*|]')",
    "E": "doc_id > min(doc_id) OVER (PARTITION BY t)",
}
_ORDERS = "SELECT " + " || ".join(f"{x}.l" for x in "pqrsu") + " AS filter_order FROM " + ", ".join(f"l {x}" for x in "pqrsu") + " WHERE " + " AND ".join(f"{x}.l <> {y}.l" for i, x in enumerate("pqrsu") for y in "pqrsu"[:i])

ORACLES["op11_filter_audit"] = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
 w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
 m AS (SELECT doc_id, part, {", ".join(f"coalesce({c}, false) AS {x}" for x, c in _FAILS.items())} FROM w),
 y AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1),
 c AS (SELECT part, A, B, C, D, E, count(*) AS n, count(*) FILTER (q = 1) AS good, count(*) FILTER (x = 1) AS bad FROM m LEFT JOIN y USING (doc_id) GROUP BY ALL),
 f AS (SELECT part, concat(CASE WHEN A THEN 'A' END, CASE WHEN B THEN 'B' END, CASE WHEN C THEN 'C' END, CASE WHEN D THEN 'D' END, CASE WHEN E THEN 'E' END) AS fails, n, good, bad FROM c),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l), o AS ({_ORDERS}), s AS (SELECT filter_order, step, filter_order[step] AS l, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
 x AS (SELECT f.*, s.*, contains(fails, l) AS hit, translate(fails, before, '') <> fails AS gone FROM f, s),
 r AS (SELECT part, filter_order, step, l, sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
 sum(n) FILTER (fails = l) AS unique_fails, sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(bad) FILTER (hit AND NOT gone) AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
 SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
 CAST(coalesce(sum(removed) OVER (PARTITION BY part, l), 0) AS BIGINT) AS shapley FROM r"""

_GRAMS = " UNION ALL ".join(f"SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS p, {k} AS k FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w WHERE len(w) >= {k})" for k in (1, 2, 3, 4))
_CUTS = " UNION ALL ".join(f"SELECT lang, p, a, {c} AS cut, array_to_string(string_split(p, ' ')[1:{c}], ' ') AS x, array_to_string(string_split(p, ' ')[{c + 1}:], ' ') AS y FROM c WHERE k > {c}" for c in (1, 2, 3))

ORACLES["op13_collocations"] = rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
 f AS (SELECT lang, p, k, count(*) AS a FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= 30), c AS (SELECT * FROM f WHERE k > 1),
 s AS (SELECT u.lang, u.p, u.a, cut, x.a AS l, y.a AS r, 2000000::HUGEINT * u.a // (x.a::HUGEINT + y.a) AS score FROM ({_CUTS}) u JOIN f x ON x.lang = u.lang AND x.p = u.x JOIN f y ON y.lang = u.lang AND y.p = u.y),
 b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS o FROM s),
 k AS (SELECT * FROM b WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = b.lang AND x.p <> b.p AND contains(' ' || x.p || ' ', ' ' || b.p || ' ') AND 100::HUGEINT * x.a >= 80 * b.a)),
 r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM k)
 SELECT lang, rank, p AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000"""

ORACLES["op12_minmax_dedup"] = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
 ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
 e AS (SELECT doc_id, unnest(s) AS t FROM g), n AS (SELECT doc_id, len(s) AS n FROM g),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
 k AS (SELECT a, min(b) AS b FROM reach GROUP BY 1), f AS (SELECT doc_id, n.n AS n_shingles, coalesce(least(doc_id, k.b), doc_id) AS component_id FROM n LEFT JOIN k ON k.a = doc_id)
 SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM f"""
