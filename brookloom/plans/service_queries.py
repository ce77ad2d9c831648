"""Queries over requests, results, tracks, fragments' states, cache writes and the retry queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookloom.functions import text as T
from brookloom.operators import cache, requests, tracks
from brookloom.plans.registry import query, table


def _view(spark, sf_dir, name, sql):
    """The rows of a statement that both engines read, over one table."""
    table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


_SYSTEM = """'Translate ' || CASE lang WHEN 'en' THEN 'English' ELSE lang END || ' to Simplified Chinese. Answer in JSON as {"translations":[{"id":"x","translated_text":"y"}]} with one entry for each block, under the same ids. Leave addresses and code as they are.'"""


@query(
    f"""SELECT doc_id, {_SYSTEM} || chr(10) || chr(10) || 'This page mentions:' || chr(10) || 'B' || chr(10) || 'a' || CASE WHEN source IS NULL THEN '' ELSE chr(10) || source END
 || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Site-specific rules:' || chr(10) || 'be brief' ELSE '' END AS prompt FROM documents WHERE lang IS NOT NULL AND coalesce(source, 'z') > 'a'"""
)
def system_prompts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang is not null and coalesce(source, 'z') > 'a'")
    site = F.when(F.col("doc_id") % 2 == 0, "be brief")
    terms = F.array(F.col("source"), F.lit("B"), F.lit("a"), F.lit("B"))
    return d.select("doc_id", requests.system_prompt(F.col("lang"), F.lit("zh"), terms, site).alias("prompt"))


@query(
    """WITH b AS (SELECT conv_id, '[' || chr(10) || string_agg('  {' || chr(10) || '    "id": "b' || turn || '",' || chr(10) || '    "text": ' || to_json(text) || chr(10) || '  }', ',' || chr(10) ORDER BY turn) || chr(10) || ']' AS said FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT conv_id, md5('{"model":"m","messages":[{"role":"system","content":"s"},{"role":"user","content":' || to_json('JSON:' || chr(10) || chr(10) || said) || '}],"response_format":{"type":"json_object"},"temperature":0.0,"max_tokens":' || greatest(1024, ceil(ceil(length(said) * 0.5) * 16))::BIGINT || ',"thinking":{"type":"disabled"},"stream":false}') AS body FROM b"""
)
def request_bodies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("b"), "turn").alias("id"), "text"))).alias("rows"))
    return rows.select("conv_id", F.md5(requests.request_body(F.col("rows"), F.lit("s"), "m")).alias("body"))


@query("SELECT conv_id AS doc_id, turn::VARCHAR AS id, text FROM conversations WHERE text <> ''")
def lenient_results(spark, sf_dir):
    """Results in four containers, ids as numbers or strings, texts under four names, some of which are empty."""
    c = table(spark, sf_dir, "conversations").where("text != ''")
    names = F.array(*map(F.lit, ("translated_text", "translation", "translatedText", "text")))
    name = F.element_at(names, (F.col("turn") % 4 + 1).cast("int"))
    ident = F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).otherwise(requests.quoted(F.col("turn").cast("string")))
    empty = F.when(F.col("turn") % 4 != 0, F.lit(',"translated_text":""')).otherwise("")
    item = F.concat(F.lit('{"id":'), ident, empty, F.lit(',"'), name, F.lit('":'), requests.quoted(F.col("text")), F.lit("}"))
    raw = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]")).alias("items"))
    k = F.col("doc_id") % 4
    held = F.when(k == 0, F.col("items")).otherwise(F.concat(F.lit('{"'), F.when(k == 1, "translations").when(k == 2, "results").otherwise("data"), F.lit('":'), "items", F.lit("}")))
    return requests.lenient_results(raw.select("doc_id", held.alias("raw")))


_TURNS = "SELECT conv_id AS doc_id, 'c' || turn % 2 AS chunk_id, 'b' || turn AS id, turn AS position, text FROM conversations WHERE text IS NOT NULL"


@query(f"SELECT * FROM ({_TURNS}) b WHERE position % 5 = 2")
def global_missing(spark, sf_dir):
    b = _view(spark, sf_dir, "conversations", _TURNS)
    return requests.global_missing(b, b.where("position % 5 != 2").withColumn("chunk_id", F.lit("any")))


@query(f"SELECT doc_id, list(id ORDER BY position) AS ids FROM ({_TURNS}) WHERE position % 5 = 2 GROUP BY doc_id")
def global_retry(spark, sf_dir):
    """Every missing block stands in one chunk of the second pass, in order."""
    b = _view(spark, sf_dir, "conversations", _TURNS)
    packed = requests.global_retry(b, b.where("position % 5 != 2"))
    return packed.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "block_ids"))), lambda x: x["block_ids"])).alias("ids"))


_CHUNKS = """SELECT user_id AS doc_id, event_id AS chunk_id, event_id % 4 AS missing, CASE WHEN event_id % 4 > 0 AND event_id % 3 < 2 THEN event_id % 3 END AS retry_missing,
 CASE event_id % 11 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'timeout' WHEN 2 THEN 'HTTP 503' END AS error FROM events"""


@query(
    f"""SELECT doc_id, count(*) FILTER (error IS NULL AND missing = 0) AS fully_ok, count(*) FILTER (error IS NULL AND missing > 0) AS needed_retry, count(*) FILTER (error IS NULL AND missing > 0 AND coalesce(retry_missing, missing) = 0) AS recovered,
count(*) FILTER (error IS NULL AND missing > 0 AND coalesce(retry_missing, missing) > 0) AS still_missing, count(*) FILTER (error IS NOT NULL) AS failed FROM ({_CHUNKS}) GROUP BY doc_id"""
)
def session_stats(spark, sf_dir):
    return requests.session_stats(_view(spark, sf_dir, "events", _CHUNKS))


@query(
    f"""SELECT doc_id, class, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, class)::INT AS place FROM (
SELECT doc_id, CASE error WHEN 'HTTP 429' THEN '429-rate-limit' WHEN 'timeout' THEN 'timeout' ELSE '5xx-server' END AS class, count(*) AS n FROM ({_CHUNKS}) WHERE error IS NOT NULL GROUP BY ALL)"""
)
def error_counts(spark, sf_dir):
    return requests.error_counts(_view(spark, sf_dir, "events", _CHUNKS))


_TRACKS = """SELECT user_id AS video_id, event_id AS ord, 'v' || event_id AS vss_id, CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'fr' END AS language,
 CASE WHEN event_id % 2 = 0 THEN 'asr' END AS kind, CASE WHEN event_id % 5 > 0 THEN 'named' ELSE '' END AS name, 'https://x/api/timedtext?v=' || user_id || '&pot=p' || event_id AS url FROM events"""
_PLAYERS = "SELECT user_id AS video_id, CASE WHEN user_id % 3 = 0 THEN 'v' || min(event_id) ELSE '' END AS selected_vss_id, CASE WHEN user_id % 3 = 1 THEN 'fr' END AS selected_language FROM events GROUP BY user_id"


@query(
    f"""SELECT video_id, vss_id, language, kind, name, url FROM (SELECT t.*, row_number() OVER (PARTITION BY video_id ORDER BY
 CASE WHEN vss_id = nullif(selected_vss_id, '') THEN 0 WHEN language = selected_language THEN 1 WHEN kind IS NULL AND name = '' THEN 2 WHEN kind IS NULL THEN 3 ELSE 4 END, ord) AS r FROM ({_TRACKS}) t JOIN ({_PLAYERS}) p USING (video_id)) WHERE r = 1"""
)
def selected_tracks(spark, sf_dir):
    t = _view(spark, sf_dir, "events", _TRACKS)
    return tracks.selected_tracks(t, spark.sql(_PLAYERS))


@query("SELECT user_id::VARCHAR AS video_id, arg_max('https://x/api/timedtext?v=' || user_id || '&pot=p' || event_id, (ts, 'https://x/api/timedtext?v=' || user_id || '&pot=p' || event_id)) AS url FROM events WHERE event_id % 3 = 0 GROUP BY user_id")
def newest_addresses(spark, sf_dir):
    """Of requests with and without token, and to other addresses, the last of each video that counts."""
    e = table(spark, sf_dir, "events")
    pot = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("&pot=p"), "event_id")).otherwise("")
    path = F.when(F.col("event_id") % 3 == 2, "/other").otherwise("/api/timedtext")
    return tracks.newest_addresses(e.select(F.concat(F.lit("https://x"), path, F.lit("?v="), "user_id", pot).alias("url"), "ts"))


_STATES = "SELECT '' || conv_id AS video_id, turn AS idx, text, CASE WHEN turn % 4 = 3 THEN 'old' END AS translated, CASE turn % 4 WHEN 0 THEN 'pending' WHEN 3 THEN 'done' ELSE 'translating' END AS status FROM conversations"


@query(
    f"""SELECT video_id, idx, text, CASE WHEN status <> 'translating' THEN translated WHEN idx % 3 = 0 THEN '> ' || idx END AS translated,
CASE WHEN status <> 'translating' THEN status WHEN idx % 3 = 0 THEN 'done' ELSE 'failed' END AS status FROM ({_STATES})"""
)
def caption_states(spark, sf_dir):
    s = _view(spark, sf_dir, "conversations", _STATES)
    text = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("> "), "idx")).otherwise("")
    return tracks.with_results(s, s.where("idx % 3 < 2").select("video_id", F.col("idx").cast("string").alias("id"), text.alias("text")))


@query(f"SELECT video_id, count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM ({_STATES}) GROUP BY video_id")
def caption_progress(spark, sf_dir):
    return tracks.progress(tracks.aborted(_view(spark, sf_dir, "conversations", _STATES)))


@query(
    """WITH e AS (SELECT user_id || event_type AS key, props AS data, epoch_us(ts) // 1000 AS ts_ms FROM events), new AS (SELECT key, max(data) || '!' AS data FROM e WHERE key LIKE '%click' GROUP BY key)
SELECT key, data, 7::BIGINT AS ts_ms, 60::BIGINT AS ttl_ms FROM new UNION ALL SELECT key, arg_max(data, (ts_ms, data)), max(ts_ms), 0 FROM e WHERE key NOT IN (SELECT key FROM new) GROUP BY key"""
)
def cache_written(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("key"), F.col("props").alias("data"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.lit(0).cast("long").alias("ttl_ms"))
    new = e.where("key like '%click'").groupBy("key").agg(F.concat(F.max("data"), F.lit("!")).alias("data"))
    return cache.written(e, new, 7, 60)


@query("SELECT user_id AS owner, event_id::VARCHAR AS key, event_id AS ts_ms, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 2 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END END AS tries FROM events WHERE event_id % 5 <> 0 OR event_id % 3 = 0")
def retry_queue(spark, sf_dir):
    """A queue from which some are taken, some tried again, and to which others are added, some of them there already."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("ts_ms"), (F.col("event_id") % 2).cast("long").alias("tries"))
    queue = cache.dequeued(rows.where("ts_ms % 3 != 0"), rows.where("ts_ms % 5 = 0"))
    queue = cache.tried_again(queue, rows.where("ts_ms % 7 = 0"))
    return cache.enqueued(queue, rows.where("ts_ms % 3 = 0").unionByName(queue.limit(5)))


@query(
    """SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'none') AS kind, 'plain' AS style, event_type <> 'view' AS has_kind FROM events"""
)
def settings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    held = requests.settings(F.create_map(F.lit("kind"), F.when(F.col("event_type") != "view", F.col("event_type"))), {"kind": "none", "style": "plain"})
    own = F.create_map(F.lit("kind"), F.when(F.col("event_type") != "view", F.col("event_type")))
    return e.select("event_id", held["kind"].alias("kind"), held["style"].alias("style"), requests.has_setting(own, "kind").alias("has_kind"))


@query(r"SELECT doc_id, len(x) > 0 AS plain, len(x) > 50 AS generic, len(x) > 10 AS later FROM (SELECT doc_id, trim(text, E' \t\n\r') AS x FROM documents WHERE text IS NOT NULL)")
def new_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", requests.worth_adding(F.lit("p"), F.col("text")).alias("plain"), requests.worth_adding(F.lit("div"), F.col("text")).alias("generic"), requests.worth_adding(F.lit("p"), F.col("text"), True).alias("later"))


@query("SELECT user_id AS gesture_id, avg(event_id * 1.0::DOUBLE) AS x, avg(value) AS y, count(*) AS n FROM events GROUP BY user_id")
def gesture_centres(spark, sf_dir):
    return tracks.centroid(table(spark, sf_dir, "events").select(F.col("user_id").alias("gesture_id"), F.col("event_id").cast("double").alias("x"), F.col("value").alias("y")))


@query(
    r"""SELECT page_id, 'https://www.youtube.com/watch' || CASE page_id % 3 WHEN 0 THEN '?v=k' || page_id WHEN 1 THEN '' ELSE 'er?v=k' END AS url, page_id % 3 = 0 AS watch, CASE WHEN page_id % 2 = 0 THEN 12.5 ELSE 0.0 END::DOUBLE AS px FROM pages"""
)
def watch_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 3
    url = F.concat(F.lit("https://www.youtube.com/watch"), F.when(k == 0, F.concat(F.lit("?v=k"), "page_id")).when(k == 1, "").otherwise("er?v=k"))
    return p.select("page_id", url.alias("url"), tracks.is_watch_page(url).alias("watch"), T.pixels(F.when(F.col("page_id") % 2 == 0, "12.5px").otherwise("auto")).alias("px"))


@query(
    """WITH last AS (SELECT user_id, event_type AS name, arg_max(event_id::VARCHAR, (ts, event_id::VARCHAR)) AS value FROM events GROUP BY ALL),
owners AS (SELECT DISTINCT user_id FROM events), defaults(name, value) AS (VALUES ('view', 'none'), ('style', 'plain'))
SELECT user_id::VARCHAR AS owner, name, value FROM last WHERE user_id % 5 <> 0
UNION ALL SELECT user_id::VARCHAR, name, value FROM owners, defaults d WHERE user_id % 5 = 0 OR NOT EXISTS (SELECT 1 FROM last l WHERE l.user_id = owners.user_id AND l.name = d.name)"""
)
def settings_written(spark, sf_dir):
    """The settings that each user's events write, kind by kind, over the defaults; those of each fifth user are reset."""
    defaults = {"view": "none", "style": "plain"}
    e = table(spark, sf_dir, "events")
    changes = e.select(F.col("user_id").cast("string").alias("owner"), F.create_map("event_type", F.col("event_id").cast("string")).alias("settings"), "ts")
    stored = changes.where("false").select("owner", "settings")
    written = requests.written_settings(stored, changes, defaults)
    again = e.where("user_id % 5 = 0").select(F.col("user_id").cast("string").alias("owner"))
    return requests.reset_settings(written, again, defaults).select("owner", F.explode("settings").alias("name", "value"))
