"""Registered queries of batches, caches, catalogues, settings, audio and progress as a whole, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import images, settings
from .operators import audio, automata, progress, reports
from .operators import text as T
from .queries import _FOLD, EVENTS, progress_events, query, table, wc
from .plans.session import scratch
from .sinks import files
from .sources import catalogue
from .streaming import events as live

# ---- batches ----------------------------------------------------------------------------------------------------

_FILES = "SELECT source, doc_id, n_chars >= 500 AS ok, n_chars AS chars, n_chars % 7 + 1 AS chapters, n_chars // 10 AS seconds, 'too short: ' || CAST(n_chars AS VARCHAR) AS error FROM documents"


def _json(expr: str) -> str:
    return f"to_json({expr})::VARCHAR"


@query(f"""WITH f AS (SELECT *, 'file_' || CAST(row_number() OVER (PARTITION BY source, ok ORDER BY doc_id) - 1 AS VARCHAR) AS file FROM ({_FILES})),
 s AS (SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS bad, CAST(sum(seconds) AS BIGINT) AS secs, CAST(coalesce(sum(chars) FILTER (WHERE ok), 0) AS BIGINT) AS chars, CAST(coalesce(sum(chapters) FILTER (WHERE ok), 0) AS BIGINT) AS chapters,
  coalesce(list({{'file': file, 'characters': chars, 'chapters': chapters, 'processing_time': seconds}} ORDER BY doc_id) FILTER (WHERE ok), []) AS g, coalesce(list({{'file': file, 'error': error}} ORDER BY doc_id) FILTER (WHERE NOT ok), []) AS b FROM f GROUP BY source)
 SELECT source, {_json("{'batch_processing': {'total_files': n, 'successful': good, 'failed': bad, 'total_processing_time': secs, 'total_characters_extracted': chars, 'total_chapters_extracted': chapters}, 'successful_files': g, 'failed_files': b}")} AS summary, round(secs / n, 6) AS average_processing_time FROM s""")
def batch_summary_json(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "source", "doc_id", (F.col("n_chars") >= 500).alias("ok"), F.col("n_chars").alias("chars"), (F.col("n_chars") % 7 + 1).alias("chapters"), F.expr("n_chars div 10").alias("seconds"), F.concat(F.lit("too short: "), F.col("n_chars").cast("string")).alias("error")
    )
    made = reports.batch_summary(rows, "source", "doc_id")
    mean = F.get_json_object("summary", "$.batch_processing.average_processing_time").cast("double")
    return made.select("source", F.regexp_replace("summary", r',"average_processing_time":[^}]*', "").alias("summary"), F.round(mean, 6).alias("average_processing_time"))


@query("SELECT user_id, CAST(len(l) AS BIGINT) AS stages, list_reduce(list_transform(l, lambda x: x.s || '=' || CAST(x.v AS VARCHAR)), lambda a, b: a || ',' || b) AS times FROM (SELECT user_id, list({'s': event_type, 'v': v} ORDER BY event_type) AS l FROM (SELECT user_id, event_type, max_by(CAST(floor(value) AS BIGINT), {'t': ts, 'e': event_id}) AS v FROM events GROUP BY user_id, event_type) GROUP BY user_id)")
def stage_timings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor("value").cast("long").alias("s"), F.struct("ts", "event_id").alias("at"))
    times = reports.stage_times(rows.withColumnRenamed("s", "seconds"), "user_id", "event_type", "seconds")
    told = F.array_join(F.transform(F.map_entries("times"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return times.select("user_id", F.size("times").cast("long").alias("stages"), told.alias("times"))


@query("SELECT role, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS calls, CAST(sum(turn + 1) AS BIGINT) AS seconds, round(sum(length(text)) / sum(turn + 1), 6) AS chars_per_second FROM conversations GROUP BY role")
def usage_rates(spark, sf_dir):
    chars, seconds = F.sum(F.length("text")).cast("long"), F.sum(F.col("turn") + 1)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(chars.alias("chars"), F.count("*").alias("calls"), seconds.alias("seconds"), F.round(F.coalesce(F.try_divide(chars, seconds), F.lit(0.0)), 6).alias("chars_per_second"))


# ---- caches and catalogues --------------------------------------------------------------------------------------

_OLD = "SELECT doc_id % 400 AS k, lang AS v, doc_id AS seq FROM documents"
_NEW = "SELECT item_id * 3 AS k, 'new' AS v, item_id * 20 AS seq FROM benchmark"


@query(f"SELECT k, v, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, fresh DESC) AS n FROM (SELECT *, 0 AS fresh FROM ({_OLD}) UNION ALL SELECT *, 1 FROM ({_NEW}))) WHERE n = 1")
def cache_write(spark, sf_dir):
    old = table(spark, sf_dir, "documents").selectExpr("doc_id % 400 AS k", "lang AS v", "doc_id AS seq")
    new = table(spark, sf_dir, "benchmark").selectExpr("item_id * 3 AS k", "'new' AS v", "item_id * 20 AS seq")
    return files.latest(old, new, "k", "seq")


_INDEX = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{broken' WHEN 1 THEN '' ELSE '{\"k' || CAST(doc_id AS VARCHAR) || '\":{\"image_path\":\"p' || CAST(doc_id % 9 AS VARCHAR) || '.png\",\"description\":\"' || lang || '\",\"confidence\":0.5}}' END AS json FROM documents"


@query("SELECT 'k' || CAST(doc_id AS VARCHAR) AS cache_key, 'p' || CAST(doc_id % 9 AS VARCHAR) || '.png' AS image_path, lang AS description, CAST(0.5 AS DOUBLE) AS confidence FROM documents WHERE doc_id % 5 > 1")
def cache_index(spark, sf_dir):
    """Entries of index texts, two of five of which are broken or empty and have none."""
    made = table(spark, sf_dir, "documents").selectExpr("doc_id", _INDEX.split("SELECT doc_id, ")[1].rsplit(" FROM documents", 1)[0].replace("VARCHAR", "STRING"))
    return catalogue.cache_index(made).select("cache_key", "entry.image_path", "entry.description", "entry.confidence")


@query("SELECT DISTINCT 'v' || CAST(doc_id % 13 AS VARCHAR) AS voice FROM documents WHERE doc_id % 2 = 0")
def voice_catalogue(spark, sf_dir):
    listing = table(spark, sf_dir, "documents").select(F.concat(F.lit("voices/v"), (F.col("doc_id") % 13).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".pt").otherwise(".txt")).alias("path"))
    return catalogue.voices(listing, ["default"])


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN (SELECT 'user' WHERE EXISTS (SELECT 1 FROM benchmark))")
def model_membership(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select(F.lit("user").alias("role"))
    return catalogue.available(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), known, "role").select("conv_id", "turn", "role")


# ---- settings ---------------------------------------------------------------------------------------------------

# Names and bounds of settings, written out once more for the oracle; the query asks the library.
_SETTINGS = {
    "engine": "['kokoro', 'elevenlabs', 'hume', 'none'][CAST(doc_id % 4 + 1 AS BIGINT)]", "speed": "doc_id % 25 / 10.0", "pitch": "doc_id % 23 / 10.0", "rate": "[16000, 22050, 44100, 48000, 8000][CAST(doc_id % 5 + 1 AS BIGINT)]",
    "form": "['wav', 'mp3', 'flac'][CAST(doc_id % 3 + 1 AS BIGINT)]", "output": "['plain', 'ssml', 'json', 'xml'][CAST(doc_id % 4 + 1 AS BIGINT)]", "low": "doc_id % 6 - 1", "high": "doc_id % 11", "jobs": "doc_id % 3",
}
_CHECKS = (
    ("engine", "engine IN ('kokoro', 'elevenlabs', 'hume')"), ("speed", "speed BETWEEN 0.5 AND 2.0"), ("pitch", "pitch BETWEEN 0.5 AND 2.0"), ("sample_rate", "rate IN (16000, 22050, 44100, 48000)"), ("output_format", "form IN ('wav', 'mp3')"),
    ("text_format", "output IN ('plain', 'ssml', 'json')"), ("min_words_per_chapter", "low >= 1"), ("max_words_per_chunk", "high >= low"), ("max_parallel_jobs", "jobs >= 1"),
)


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN NOT ({test}) THEN {chr(39)}{name}{chr(39)} END' for name, test in _CHECKS)}], lambda x: x IS NOT NULL), ',') AS invalid FROM (SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in _SETTINGS.items())} FROM documents)")
def settings_checks(spark, sf_dir):
    """All nine checks of settings, over rows of settings."""

    def pick(values, n):
        return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))

    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", pick(("kokoro", "elevenlabs", "hume", "none"), 4).alias("engine"), (d % 25 / 10.0).alias("speed"), (d % 23 / 10.0).alias("pitch"), pick((16000, 22050, 44100, 48000, 8000), 5).alias("rate"),
        pick(("wav", "mp3", "flac"), 3).alias("form"), pick(("plain", "ssml", "json", "xml"), 4).alias("output"), (d % 6 - 1).alias("low"), (d % 11).alias("high"), (d % 3).alias("jobs"),
    )
    names = {"engine": "engine", "speed": "speed", "pitch": "pitch", "rate": "sample_rate", "form": "format", "output": "text_format", "low": "min_words", "high": "max_words", "jobs": "max_jobs"}
    return rows.select("doc_id", F.array_join(settings.invalid({n: F.col(c) for c, n in names.items()}), ",").alias("invalid"))


# ---- audio and pixels -------------------------------------------------------------------------------------------


@query("SELECT CAST(vec_id AS VARCHAR) AS name, CAST(44 + 2 * len(embedding) AS BIGINT) AS bytes, 'RIFF' AS head FROM embeddings")
def audio_files(spark, sf_dir):
    made = files.encoded_audio(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 24000)
    return made.select("name", F.octet_length("audio").cast("long").alias("bytes"), F.substring("audio", 1, 4).cast("string").alias("head"))


_PCM = "CAST(trunc(greatest(-1.0, least(1.0, CAST(x AS DOUBLE))) * 32767) AS INTEGER)"


@query(f"SELECT CAST(vec_id AS VARCHAR) AS name, CAST(len(l) AS BIGINT) AS n, CAST(list_sum(l) AS BIGINT) AS total, md5(array_to_string(l, ',')) AS digest FROM (SELECT vec_id, list_transform(embedding, lambda x: {_PCM}) AS l FROM embeddings)")
def audio_samples(spark, sf_dir):
    """Every sample of the encoded files, read back from their bytes."""
    made = files.encoded_audio(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 24000)
    hexes = F.regexp_extract_all(F.hex(F.expr("substring(audio, 45, octet_length(audio))")), F.lit("(..)(..)"), F.lit(0))
    value = lambda h: F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int")
    signed = F.transform(hexes, lambda h: F.when(value(h) >= 32768, value(h) - 65536).otherwise(value(h)))
    rows = made.select("name", signed.alias("l"))
    return rows.select("name", F.size("l").cast("long").alias("n"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.md5(F.array_join(F.transform("l", lambda x: x.cast("string")), ",").cast("binary")).alias("digest"))


@query("SELECT label, CAST(count(DISTINCT vec_id) AS BIGINT) AS clips, CAST(sum(len(embedding)) AS BIGINT) AS n, round(CAST(list(embedding ORDER BY vec_id)[1][1] AS DOUBLE), 6) AS head, round(CAST(list(embedding ORDER BY vec_id)[-1][-1] AS DOUBLE), 6) AS tail FROM embeddings GROUP BY label")
def streamed_audio(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    joined = audio.recording_info(audio.crossfaded(rows, "label", "vec_id", "embedding", 0), "label").join(rows.groupBy("label").agg(F.count_distinct("vec_id").alias("clips")), "label")
    return joined.select("label", "clips", "n", F.round("head", 6).alias("head"), F.round("tail", 6).alias("tail"))


_FADED = "list_reduce(list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id), lambda a, b: a[: len(a) - 16] || list_transform(range(1, 17), lambda i: a[len(a) - 16 + i] * (1 - i / 17.0::DOUBLE) + b[i] * (i / 17.0::DOUBLE)) || b[17:])"


@query(f"SELECT label, CAST(unnest(range(len(l))) AS BIGINT) AS pos, round(unnest(l), 6) AS sample FROM (SELECT label, {_FADED} AS l FROM embeddings GROUP BY label)")
def clip_sequence(spark, sf_dir):
    """The clips of each label as one recording, each fading into the next over 16 samples."""
    frames = audio.crossfaded(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 16, 1000)
    return audio.samples_of(frames, "label", 1000).select("label", "pos", F.round("sample", 6).alias("sample"))


#: Messages of engines, by the kind and number of an event.
_MESSAGE = "CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'MTLCommandBuffer: commit call failed' WHEN event_type = 'error' THEN 'voice not found' WHEN event_type = 'purchase' AND event_id % 11 = 0 THEN 'Metal' ELSE event_type END"
_GRAPHICS = " OR ".join(f"contains(message, '{p}')" for p in automata.GRAPHICS_ERRORS)


@query(f"""SELECT event_id, engine, errors, CAST(CASE WHEN errors = 0 THEN 0 WHEN errors < 3 THEN 1 ELSE 2 END AS INTEGER) AS level FROM (SELECT event_id, engine, CAST(least(3, sum(CASE WHEN {_GRAPHICS} THEN 1 ELSE 0 END) OVER (PARTITION BY engine ORDER BY ts, event_id)) AS INTEGER) AS errors
 FROM (SELECT event_id, ts, user_id % 7 AS engine, {_MESSAGE} AS message FROM events))""")
def engine_degradation(spark, sf_dir):
    """Level of each engine after every event, in blocks of days."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id % 7 AS engine", f"{_MESSAGE} AS message").withColumn("day", F.to_date("ts")).withColumn("at", F.struct("ts", "event_id"))
    return automata.degradation(rows, "engine", "day", "at", "message").select("event_id", "engine", "errors", "level")


_PIXELS = "SELECT vec_id, CAST(floor(unnest(embedding) * 8) AS BIGINT) AS color FROM embeddings"


@query(f"SELECT vec_id, color, count(*) AS n FROM ({_PIXELS}) GROUP BY vec_id, color")
def pixel_histogram(spark, sf_dir):
    return images.pixel_histogram(_pixels(spark, sf_dir), "vec_id", "pixels")


def _pixels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 8)).alias("pixels"))


@query(f"SELECT vec_id, color, n FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, color) AS r FROM (SELECT vec_id, color, count(*) AS n FROM ({_PIXELS}) GROUP BY vec_id, color)) WHERE r = 1")
def dominant_color(spark, sf_dir):
    return images.dominant_color(_pixels(spark, sf_dir), "vec_id", "pixels")


#: A picture of every vector, a pixel for each entry: its level v as red v, green 255 - v and blue v // 2.
_LEVELS = "list_transform(embedding, lambda x: CAST(least(255, floor(abs(x) * 16) * 16) AS BIGINT))"
_RGB = f"SELECT vec_id, len(l) AS n, unnest(list_transform(l, lambda v: v * 65536 + (255 - v) * 256 + v // 2)) AS color FROM (SELECT vec_id, {_LEVELS} AS l FROM embeddings)"


def _pictures(spark, sf_dir):
    """The pictures written as PNG files in the shared folder, and read again by Spark's image source."""
    level = lambda x: F.least(F.lit(255), F.floor(F.abs(x) * 16) * 16)
    hexes = lambda x: F.concat(F.lpad(F.hex(level(x)), 2, "0"), F.lpad(F.hex(255 - level(x)), 2, "0"), F.lpad(F.hex(F.floor(level(x) / 2)), 2, "0"))
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") > 0)
    raw = rows.select(F.concat(F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), F.size("embedding").alias("width"), F.lit(1).alias("height"), F.unhex(F.array_join(F.transform("embedding", hexes), "")).alias("rgb"))
    folder = scratch(spark)
    files.write_files(images.encoded(raw), folder, "path", "png").agg(F.sum("bytes")).collect()
    read = images.read_pixels(spark, folder)
    return read.withColumn("path", F.regexp_extract("path", r"(\d+)\.png$", 1))


@query(f"SELECT vec_id, color, n FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, color) AS r FROM (SELECT vec_id, color, count(*) AS n FROM ({_RGB}) GROUP BY 1, 2)) WHERE r = 1")
def picture_main_color(spark, sf_dir):
    """Most frequent color of each decoded picture."""
    return images.main_color(_pictures(spark, sf_dir)).select(F.col("path").cast("long").alias("vec_id"), "color", "n")


@query(f"SELECT vec_id, color, count(*) AS n FROM ({_RGB}) GROUP BY 1, 2")
def picture_colors(spark, sf_dir):
    return images.colors(_pictures(spark, sf_dir)).select(F.col("path").cast("long").alias("vec_id"), "color", "n")


_SIDES = "doc_id, text, n_chars % 700 + 1 AS w, doc_id * 37 % 600 + 1 AS h, CASE WHEN doc_id % 9 > 0 THEN doc_id * 1048573 % 16777216 END AS c"
_SHOWN = " ".join(f"WHEN {' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{said}'" for words, said in images.SHOWN)


@query(f"""SELECT doc_id, CASE WHEN length(d) > 40 THEN substr(d, 1, 37) || '...' ELSE d END AS description, round(0.75 + CAST('0x' || substr(md5(CAST(w AS VARCHAR) || 'x' || CAST(h AS VARCHAR)), 1, 6) AS BIGINT) % 25 / 100.0, 6)::DOUBLE AS confidence
 FROM (SELECT doc_id, w, h, 'A ' || CASE WHEN w > h THEN 'landscape' WHEN h > w THEN 'portrait' ELSE 'square' END || ' ' || CASE WHEN c IS NULL THEN 'colored' WHEN r > g AND r > b THEN 'reddish' WHEN g > r AND g > b THEN 'greenish' WHEN b > r AND b > g THEN 'bluish' ELSE 'neutral-toned' END || ' image' || CASE {_SHOWN} ELSE '' END AS d
 FROM (SELECT *, c // 65536 AS r, c // 256 % 256 AS g, c % 256 AS b, lower(coalesce(text, '')) AS low FROM (SELECT {_SIDES} FROM documents)))""")
def picture_description(spark, sf_dir):
    """What size, color and context say of a picture, cut to 40 characters."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "n_chars % 700 + 1 AS w", "doc_id * 37 % 600 + 1 AS h", "CASE WHEN doc_id % 9 > 0 THEN doc_id * 1048573 % 16777216 END AS c")
    return rows.select("doc_id", images.plain_description(F.col("w"), F.col("h"), F.col("c"), F.col("text"), 40).alias("d")).select("doc_id", "d.*")


# ---- progress ---------------------------------------------------------------------------------------------------

_STATUS = f"""SELECT f.pipeline, f.total_items, f.completed_items, f.errors, f.warnings, round(CASE WHEN total_items > 0 THEN least(100.0, 100.0 * completed_items / total_items) ELSE 0.0 END, 6) AS percent, round(elapsed, 6) AS elapsed,
 round(CASE WHEN total_items = 0 OR completed_items = 0 THEN NULL WHEN total_items <= completed_items THEN 0.0 WHEN elapsed > 0 THEN (total_items - completed_items) * elapsed / completed_items END, 6) AS eta_seconds,
 total_items > 0 AND completed_items < total_items AND working AS active FROM ({_FOLD}) f JOIN (SELECT pipeline, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000.0::DOUBLE AS elapsed,
 coalesce(max_by(event_type, {{'t': ts, 'e': event_id}}) FILTER (WHERE event_type IN ('start', 'progress', 'complete')) IN ('start', 'progress'), false) AS working FROM ({EVENTS}) GROUP BY pipeline) t ON f.pipeline = t.pipeline"""


@query(_STATUS)
def progress_status(spark, sf_dir):
    return progress.status(progress_events(spark, sf_dir))


@query(f"SELECT CAST(sum(total_items) AS BIGINT) AS total_items, CAST(sum(completed_items) AS BIGINT) AS completed_items, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings, round(CASE WHEN sum(total_items) > 0 THEN least(100.0, 100.0 * sum(completed_items) / sum(total_items)) ELSE 0.0 END, 6) AS percent, max(eta_seconds) FILTER (WHERE eta_seconds > 0) AS eta_seconds, coalesce(string_agg(pipeline, ',' ORDER BY pipeline) FILTER (WHERE active), '') AS active FROM ({_STATUS})")
def progress_rollup(spark, sf_dir):
    return progress.roll_up(progress.status(progress_events(spark, sf_dir)))


_RAW = "SELECT event_id, ts, CASE WHEN user_id % 5 = 0 THEN 'other' ELSE ['tts', 'image', 'epub'][CAST(user_id % 3 + 1 AS BIGINT)] END AS pipeline, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'progress' WHEN 'signup' THEN NULL WHEN 'error' THEN 'error' ELSE 'complete' END AS event_type FROM events"


def _raw_events(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "progress").when(F.col("event_type") == "error", "error").when(F.col("event_type") != "signup", "complete")
    name = F.when(F.col("user_id") % 5 == 0, "other").otherwise(F.element_at(F.array(F.lit("tts"), F.lit("image"), F.lit("epub")), (F.col("user_id") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", "ts", name.alias("pipeline"), kind.alias("event_type"))


@query(f"SELECT ok, coalesce(pipeline, '') AS pipeline, coalesce(event_type, '') AS event_type, count(*) AS n FROM (SELECT *, coalesce(ts IS NOT NULL AND pipeline IN ('tts', 'image', 'epub', 'overall') AND event_type IN ('start', 'progress', 'complete', 'error', 'warning', 'info'), false) AS ok FROM ({_RAW})) GROUP BY 1, 2, 3")
def event_ingest(spark, sf_dir):
    good, bad = live.ingested(_raw_events(spark, sf_dir))
    both = good.withColumn("ok", F.lit(True)).union(bad.withColumn("ok", F.lit(False)))
    return both.groupBy("ok", F.coalesce("pipeline", F.lit("")).alias("pipeline"), F.coalesce("event_type", F.lit("")).alias("event_type")).agg(F.count("*").alias("n"))


_STOPS = "SELECT event_id, ts, CASE WHEN event_id % 1000 = 777 THEN 'overall' ELSE 'tts' END AS pipeline, CASE WHEN event_id % 1000 = 777 THEN 'info' ELSE 'progress' END AS event_type, CASE WHEN event_id % 1000 = 777 THEN 'shutdown' END AS action FROM events"


@query(f"WITH e AS ({_STOPS}), s AS (SELECT min({{'t': ts, 'e': event_id}}) AS stop FROM e WHERE action = 'shutdown') SELECT event_id, pipeline, event_type FROM e, s WHERE stop IS NULL OR {{'t': ts, 'e': event_id}} < stop")
def events_before_shutdown(spark, sf_dir):
    stop = F.col("event_id") % 1000 == 777
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.when(stop, "overall").otherwise("tts").alias("pipeline"), F.when(stop, "info").otherwise("progress").alias("event_type"), F.when(stop, "shutdown").alias("action"))
    return live.before_shutdown(rows).select("event_id", "pipeline", "event_type")


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, event_type || '_' || CAST(epoch_us(ts) // 1000 AS VARCHAR) AS name, CASE WHEN length(props) > 8 THEN substr(props, 1, 5) || '...' ELSE props END AS label FROM events")
def event_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.select("event_id", progress.clock_time(F.unix_micros("t") / 1e6).alias("clock"), F.concat_ws("_", "event_type", F.unix_millis("t").cast("string")).alias("name"), progress.shortened(F.col("props"), 8).alias("label"))


@query(f"SELECT doc_id, CAST(json_extract(m, '$.words') AS BIGINT) AS words, json_extract_string(m, '$.lang') AS lang FROM (SELECT doc_id, '{{\"words\":' || CAST({wc('text')} AS VARCHAR) || ',\"lang\":\"' || lang || '\"}}' AS m FROM documents)")
def metadata_from_json(spark, sf_dir):
    made = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(T.word_count(F.col("text")).alias("words"), "lang")).alias("m"))
    return made.select("doc_id", F.from_json("m", "words long, lang string").alias("r")).select("doc_id", "r.words", "r.lang")
