"""The registered queries of this subpackage, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import (
    chat,
    exact,
    filter_audit,
    language,
    mixing,
    neighbours,
    pieces,
    recompression,
    simhash,
    spelling,
    suffixes,
    toxicity,
    warc,
)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_chat_formatting",
    r"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ),
    sorted AS (
      SELECT *, lag(role) OVER w AS before FROM rows
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    ),
    written AS (
      SELECT *,
        CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System'
          ELSE '=' || replace(replace(replace(replace(replace(
            role, '\', '\\'), '###', '\h'), '<next/>', '\n'), '</turn>', '\e'), ': ', '\c') END AS shown,
        replace(replace(replace(replace(replace(
          text, '\', '\\'), '###', '\h'), '<next/>', '\n'), '</turn>', '\e'), ': ', '\c') AS body
      FROM sorted
    )
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
      (sum(length(body)) + sum(CASE WHEN before = role THEN 7 ELSE 4 + length(shown) + 2 + 8 END))::BIGINT
        AS formatted_chars
    FROM written GROUP BY conv_id
    """,
)
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    chats = chat.read_chats(chat.format_chats(rows))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.filter("segments", lambda s: s["loss"])
    loss = F.array_join(F.transform(masked, lambda s: chat.unescape(s["text"])), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        loss.alias("loss"),
    ).select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query(
    "op7_exact_dedup",
    """
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
    FROM (
      SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        sha256(coalesce(text, '')) AS text_sha256
      FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    )
    """,
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    shown = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


@query(
    "op9_warc",
    """
    WITH base32 AS (
      SELECT page_id, coalesce(html, '') AS html,
        ('0x' || sha1(coalesce(html, '')))  AS hex FROM pages
    ),
    first AS (SELECT html, max(page_id) AS first FROM base32 GROUP BY html)
    SELECT page_id, strlen(html) AS payload_bytes,
      list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (('0x' || substr(hex, 3 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) % 32 + 1, 1)
        FOR i IN range(32)], 'string_agg', '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to
    FROM base32 JOIN first USING (html)
    """,
)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(warc.page_records(table(spark, sf_dir, "pages")))
    number = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    responses = warc.read_archive(spark, path).where("record_type = 'response'")
    # Of responses, size and digest are those of the payload read back; the digest is compared with the header's.
    read = responses.select(
        number(F.col("record_id")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.sha1("payload") == warc.hex_of(F.col("payload_digest")), F.col("payload_digest")).alias(
            "payload_digest"
        ),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = warc.read_archive(spark, path, payload="false").where("record_type = 'revisit'")
    return read.unionByName(
        revisits.select(
            number(F.col("record_id")).alias("page_id"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            number(F.col("refers_to")).alias("refers_to"),
        )
    )


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def text_form(text: Column) -> Column:
    """A rule-based topic for tables without one: what form a text has."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("!!")), "shout")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")), "contact")
        .otherwise("prose")
    )


def mixed(docs: DataFrame, budget: float) -> DataFrame:
    margins = {"source": docs["source"], "lang": docs["lang"], "topic": text_form(F.coalesce(docs["text"], F.lit("")))}
    return mixing.mix(docs, margins, budget=budget)


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), 0.5).select("doc_id", "mix.*")


PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def in_pieces(docs: DataFrame, keep: list[str], model: str = PIECES) -> DataFrame:
    """`keep` columns, `ids`, and `decoded` from these ids."""
    return pieces.encode(docs, pieces.model_bytes(model), keep, read_back=True)


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("given", F.sha2(F.coalesce("text", F.lit("")), 256))
    return in_pieces(docs, ["doc_id", "given"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.sha2("decoded", 256) == F.col("given")).alias("round_trip"),
    )


@query("op4_nearest_neighbours")
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recompression.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op13_filter_audit",
    r"""
    WITH given AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ),
    judged AS (
      SELECT doc_id, part, concat(
        CASE WHEN len(words) < 200 THEN 'A' END,
        CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
        CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' END,
        CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
        CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END) AS fails
      FROM given
    ),
    marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    cells AS (
      SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic
      FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, fails
    ),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    orders AS (
      SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
      FROM letters a, letters b, letters c, letters d, letters e
      WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
    ),
    placed AS (SELECT filter_order, step, substr(filter_order, step, 1) AS l FROM orders, range(1, 6) s(step)),
    counted AS (
      SELECT part, filter_order, step::INT AS step, l,
        sum(n) FILTER (first > step) AS kept, sum(n) FILTER (first = step) AS removed,
        sum(n) FILTER (contains(fails, l) AND first < step) AS redundant,
        sum(n) FILTER (fails = l) AS unique_fails,
        sum(good) FILTER (first = step) AS good_lost, sum(toxic) FILTER (first = step) AS toxic_lost
      FROM (
        SELECT *, coalesce(list_min(list_transform(string_split(fails, ''), lambda f: CASE WHEN f <> '' THEN strpos(filter_order, f) END)), 9)
          AS first
        FROM cells, placed
      ) GROUP BY part, filter_order, step, l
    )
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
      coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
      coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
      coalesce(sum(removed) OVER (PARTITION BY part, l), 0)::BIGINT AS shapley
    FROM counted
    """,
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op12_spelling_variants",
    r"""
    WITH RECURSIVE entries AS (
      SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)
        ORDER BY i) AS entry FROM range(256) r(i)
    ),
    runs AS (
      SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
      ) WHERE length(run) >= 5 GROUP BY doc_id, run
    ),
    hashed AS (
      SELECT run, n, xor(4294967295, list_reduce(
        flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda ch:
          CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] ELSE [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] END)),
        lambda c, b: xor(c >> 8, entry[(xor(c, b::BIGINT) & 255) + 1]), 4294967295)) AS h
      FROM runs, entries
    ),
    words AS (
      SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END
          AS word FROM hashed
      ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
    ),
    cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, length(word) + 1) r(i)),
    near AS (
      SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
    ),
    best AS (
      SELECT word, count(*) AS n_near, max(other_n) AS most,
        arg_min(other, struct_pack(x := -other_n, y := other)) AS other
      FROM near GROUP BY word
    ),
    formed AS (
      SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN other END AS form,
        CASE WHEN most >= 2 * n THEN most END AS form_n
      FROM words LEFT JOIN best USING (word)
    ),
    rooted AS (
      SELECT word, word AS root FROM formed WHERE form IS NULL
      UNION ALL SELECT f.word, r.root FROM formed f JOIN rooted r ON f.form = r.word
    )
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN rooted USING (word)
    """,
)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(table(spark, sf_dir, "documents"), typo_every=97)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op11_language_id")
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model, ["doc_id"])
    held_out = language.held_out(F.col("doc_id")).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "ambiguous")
