"""Queries of attempts, chains of resources, settings of older versions and finished tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import attempts, model_output
from leafmill.plans import views as v
from leafmill.plans.register import query
from leafmill.sources.shared import folder
from leafmill.streaming import queue as streams

#: Answers made of the turns: bare text, which is no JSON; a summary of the whole text with too few bullets; one with three.
ANSWERED = """WITH a AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS attempt, length(text) AS n, length(text) % 10 / 4.0 AS duration_s,
  CASE WHEN (conv_id + turn) % 4 = 0 THEN 'no JSON' WHEN (conv_id + turn) % 4 = 1 THEN 'schema' WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 20 THEN 'too short' END AS problem FROM conversations)"""


@query(
    ANSWERED
    + f""", w AS (SELECT *, min(CASE WHEN problem IS NULL AND attempt <= 3 THEN attempt END) OVER (PARTITION BY conv_id) AS won FROM a),
    k AS (SELECT * FROM w WHERE attempt <= coalesce(won, 3))
    SELECT conv_id, any_value(won) AS won, CAST(count(*) AS INTEGER) AS attempts, round(sum(duration_s), 2) AS duration_s, arg_max(coalesce(problem, ''), attempt) AS problem,
      CASE WHEN any_value(won) IS NOT NULL THEN '' WHEN count(*) >= 3 THEN '' WHEN arg_max(problem, attempt) = 'no JSON' THEN '{attempts.NO_JSON}' ELSE '{attempts.NOT_GOOD[0]}' || arg_max(problem, attempt) || ': ' || arg_max(n, attempt) || '{attempts.NOT_GOOD[1]}' END AS suffix
    FROM k GROUP BY conv_id""",
    with_views=False,
)
def attempts_settled(spark, d):
    """Every conversation as the attempts at one summary, each turn an answer of the whole text."""
    from pyspark.sql import Window

    c = v.table(spark, d, "conversations")
    bullets = lambda n: F.array(*[F.struct(F.lit(f"p{i}").alias("label"), F.col("text").alias("body")) for i in range(n)])
    made = lambda n: F.to_json(F.struct(F.array(F.lit("one sentence")).alias("sentences"), bullets(n).alias("bullets"), F.lit("L").alias("label"), F.lit("A").alias("anchor")))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    raw = F.when(kind == 0, F.concat(F.lit("no answer: "), F.translate("text", "{}[]", "()()"))).when(kind == 1, made(1)).otherwise(made(3))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    answers = c.select("conv_id", place.alias("attempt"), (F.length("text") % 10 / 4).alias("duration_s"), F.length("text").alias("n"), model_output.summary(raw).alias("s"))
    judged = answers.withColumn("problem", model_output.problem(F.col("s"))).withColumn("detail", F.concat_ws(": ", "problem", "n"))
    done = attempts.settled(judged, "conv_id")
    return done.select("conv_id", "won", "attempts", "duration_s", F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("suffix", F.lit("")).alias("suffix"))


CHAINS = [("chat", 0, "o1", "openai", True), ("chat", 1, "o2", "ollama", True), ("chat", 2, "o3", "openrouter", True), ("chat", 3, "o4", "cursor", False), ("summarize", 0, "o2", "ollama", True), ("summarize", 1, "o3", "openrouter", True), ("translate", 0, "o3", "openrouter", True), ("translate", 1, "o2", "ollama", False)]


@query(
    f"""WITH chains(profile, pos, resource, provider, configured) AS (VALUES {", ".join(f"('{p}', {i}, '{r}', '{q}', {c})" for p, i, r, q, c in CHAINS)}),
    calls AS (SELECT event_id AS call_id, CASE event_type WHEN 'error' THEN 'summarize' WHEN 'click' THEN 'translate' WHEN 'signup' THEN 'none' ELSE 'chat' END AS profile, user_id, value FROM events),
    o AS (SELECT c.call_id, c.profile, h.pos, h.resource, h.provider, h.configured, (c.user_id + h.pos) % 3 = 0 AS busy, c.value / 2 AS seconds, CASE WHEN (c.call_id + CAST(substr(h.resource, 2) AS INTEGER)) % 4 <> 1 THEN 'HTTP ' || (500 + h.pos) END AS error,
      h.pos < max(CASE WHEN h.configured THEN h.pos END) OVER (PARTITION BY c.call_id) AND c.profile <> 'summarize' AS waits FROM calls c JOIN chains h ON c.profile = h.profile),
    f AS (SELECT *, configured AND waits AND provider = 'ollama' AND NOT busy AND seconds > 12 AS given_up, CASE WHEN waits AND busy THEN 'busy' WHEN waits AND provider = 'ollama' AND seconds > 12 THEN 'timeout' ELSE error END AS failure FROM o),
    g AS (SELECT call_id, min(CASE WHEN configured AND failure IS NULL THEN pos END) AS ok_at, arg_max(coalesce(failure, ''), CASE WHEN configured THEN pos END) AS last_failure, bool_or(given_up) AS any_given_up, bool_or(provider = 'ollama') AS has_local,
      bool_or(provider = 'ollama' AND configured) AS local_tried, max(CASE WHEN provider = 'ollama' THEN coalesce(error, '') END) AS local_error, max(CASE WHEN provider = 'ollama' THEN pos END) AS local_at FROM f GROUP BY call_id),
    r AS (SELECT *, ok_at IS NULL AND has_local AND (any_given_up OR NOT local_tried) AS retried FROM g),
    a AS (SELECT *, CASE WHEN ok_at IS NOT NULL THEN ok_at WHEN retried AND local_error = '' THEN local_at END AS place FROM r)
    SELECT c.call_id, CAST(a.place AS INTEGER) AS place, (SELECT any_value(h.resource) FROM chains h WHERE h.profile = c.profile AND h.pos = a.place) AS resource, coalesce(a.retried, false) AS retried,
      coalesce((SELECT string_agg(f.resource, ',' ORDER BY f.pos) FROM f WHERE f.call_id = c.call_id AND f.configured AND (a.ok_at IS NULL OR f.pos <= a.ok_at)), '') AS tried,
      CASE WHEN a.place IS NULL THEN CASE WHEN a.retried THEN local_error ELSE last_failure END END AS error FROM calls c LEFT JOIN a ON c.call_id = a.call_id""",
    with_views=False,
)
def calls_routed(spark, d):
    """Every event as a call, by a profile of its type; how a resource answers follows from the event."""
    e = v.table(spark, d, "events")
    t = F.col("event_type")
    calls = e.select(F.col("event_id").alias("call_id"), F.when(t == "error", "summarize").when(t == "click", "translate").when(t == "signup", "none").otherwise("chat").alias("profile"), "user_id", "value")
    chains = spark.createDataFrame(CHAINS, "profile string, pos int, resource string, provider string, configured boolean")
    met = calls.join(F.broadcast(chains), "profile")  # a settings table of eight rows
    error = F.when((F.col("call_id") + F.substring("resource", 2, 9).cast("int")) % 4 != 1, F.concat(F.lit("HTTP "), (500 + F.col("pos")).cast("string")))
    outcomes = met.select("call_id", "resource", ((F.col("user_id") + F.col("pos")) % 3 == 0).alias("busy"), (F.col("value") / 2).alias("seconds"), error.alias("error"))
    return attempts.routed(calls, chains, outcomes).withColumn("tried", F.array_join("tried", ","))


PRESETS = [("ollama", "ollama", "http://127.0.0.1:11434", "local", 1), ("openai", "openai", None, "m", 4), ("cursor", "cursor", None, None, 8)]
PROVIDERS = ("ollama", "Open AI Compatible", " Cursor", "本机!")
OLD = f"""WITH p AS (SELECT page_id AS settings_id, [{", ".join(f"'{x}'" for x in PROVIDERS)}][page_id % 4 + 1] AS provider, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS base_url, 'm' || page_id % 5 AS model, page_id // 4 % 2 = 0 AS old, page_id % 5 > 0 AS has_jobs, CAST(page_id % 3 AS INTEGER) AS few FROM pages),
i AS (SELECT *, lower(trim(provider)) AS name, trim(regexp_replace(lower(left(string_split(rtrim(base_url, '/'), '//')[-1], 24)), '[^a-z0-9]+', '-', 'g'), '-') AS host, coalesce(nullif(trim(regexp_replace(lower(trim(provider)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'custom') AS slug FROM p),
n AS (SELECT *, CASE WHEN name IN ('ollama', 'openai', 'openrouter', 'cursor', 'aiping') THEN name WHEN base_url <> '' AND host <> '' THEN slug || '-' || host ELSE slug END AS id FROM i)"""


def _settings(spark, d):
    n = F.col("page_id")
    provider, url = F.element_at(F.array(*map(F.lit, PROVIDERS)), (n % 4 + 1).cast("int")), F.when(n % 3 == 0, "").otherwise(F.col("url"))
    jobs = F.when(n % 5 > 0, F.create_map(F.lit("ollama"), (n % 3).cast("int"), F.lit("cloud"), F.lit(6)))
    model = F.concat(F.lit("m"), n % 5)
    old = F.struct(F.struct(provider.alias("provider"), url.alias("base_url"), model.alias("model")).alias("chat"), F.struct(F.lit("ollama").alias("provider"), F.lit("").alias("base_url"), F.lit("s").alias("model")).alias("summarize"), jobs.alias("job_concurrency"))
    first = F.struct(F.lit("a").alias("id"), provider.alias("provider"), url.alias("base_url"), model.alias("model"), (n % 3).cast("int").alias("concurrency"))
    second = F.struct(F.lit("b").alias("id"), F.lit("cursor").alias("provider"), F.lit(None).cast("string").alias("base_url"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("int").alias("concurrency"))
    new = F.struct(F.struct(F.array(F.lit("a"), F.lit("b")).alias("priority")).alias("chat"), F.array(first, second).alias("resources"), jobs.alias("job_concurrency"))
    raw = F.when(F.floor(n / 4) % 2 == 0, F.to_json(old)).otherwise(F.to_json(new))
    return v.table(spark, d, "pages").select(n.alias("settings_id"), raw.alias("raw"))


def _migrated(spark, d):
    presets = spark.createDataFrame(PRESETS, "resource_id string, provider string, base_url string, model string, concurrency int")
    return attempts.migrated(_settings(spark, d), presets)


@query(
    OLD
    + """, presets(resource_id, provider, base_url, model, concurrency) AS (VALUES ('ollama', 'ollama', 'http://127.0.0.1:11434', 'local', 1), ('openai', 'openai', NULL, 'm', 4), ('cursor', 'cursor', NULL, NULL, 8)),
    b AS (SELECT settings_id, 0 AS pos, id AS resource_id, provider, base_url, model FROM n WHERE old UNION ALL SELECT settings_id, 1, 'ollama', 'ollama', '', 's' FROM n WHERE old),
    own AS (SELECT settings_id, resource_id, arg_max(provider, pos) AS provider, arg_max(base_url, pos) FILTER (base_url <> '') AS base_url, arg_max(model, pos) AS model FROM b GROUP BY ALL),
    pre AS (SELECT n.settings_id, p.* FROM n, presets p WHERE n.old),
    r AS (SELECT coalesce(o.settings_id, p.settings_id) AS settings_id, coalesce(o.resource_id, p.resource_id) AS resource_id, coalesce(o.provider, p.provider) AS provider, coalesce(o.base_url, p.base_url) AS base_url, coalesce(o.model, p.model) AS model, p.concurrency
      FROM own o FULL JOIN pre p ON o.settings_id = p.settings_id AND o.resource_id = p.resource_id
      UNION ALL SELECT settings_id, 'a', provider, base_url, model, few FROM n WHERE NOT old UNION ALL SELECT settings_id, 'b', 'cursor', NULL, NULL, NULL FROM n WHERE NOT old)
    SELECT r.settings_id, r.resource_id, r.provider, r.base_url, r.model, CAST(CASE WHEN coalesce(r.concurrency, 0) = 0 AND n.has_jobs THEN CASE lower(trim(r.provider)) WHEN 'ollama' THEN greatest(1, n.few) WHEN 'cursor' THEN 8 ELSE 6 END ELSE r.concurrency END AS INTEGER) AS concurrency
    FROM r JOIN n ON r.settings_id = n.settings_id""",
    with_views=False,
)
def settings_migrated(spark, d):
    return _migrated(spark, d)[0]


@query(OLD + " SELECT settings_id, 'chat' AS profile, CASE WHEN old THEN id ELSE 'a,b' END AS priority FROM n UNION ALL SELECT settings_id, 'summarize', 'ollama' FROM n WHERE old", with_views=False)
def settings_routes(spark, d):
    return _migrated(spark, d)[1].withColumn("priority", F.array_join("priority", ","))


FINISHED = "WITH f AS (SELECT 'u' || user_id % 7 AS key, event_id AS task_id, event_id AS seq FROM events WHERE event_type IN ('purchase', 'error'))"


def _finished(spark, d):
    return v.table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error")).select(F.concat(F.lit("u"), F.col("user_id") % 7).alias("key"), F.col("event_id").alias("task_id"), F.col("event_id").alias("seq"))


@query(FINISHED + " SELECT key, task_id, CAST(row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS INTEGER) AS place, count(*) OVER (PARTITION BY key) AS n_finished FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) <= 50", with_views=False)
def tasks_recent(spark, d):
    return attempts.recent(_finished(spark, d), "key").select("key", "task_id", "place", "n_finished")


@query(FINISHED + " SELECT key, task_id, CAST(row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS INTEGER) AS place, count(*) OVER (PARTITION BY key) AS n_finished FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) <= 50", with_views=False)
def tasks_recent_streamed(spark, d):
    """The same from a stream in three pieces."""
    finished, path, out, checkpoint = _finished(spark, d), folder(spark, "finished"), folder(spark, "said"), folder(spark, "streams")
    finished.repartition(3, "task_id").write.parquet(path)
    stream = spark.readStream.schema(finished.schema).option("maxFilesPerTrigger", 1).parquet(path)
    streams.to_folder(streams.recent(stream, attempts.SHOWN), out, checkpoint).awaitTermination()
    said = streams.latest(streams.said(spark, out, streams.RING), "key")
    return said.select("key", F.posexplode("task_ids").alias("i", "task_id"), "n_finished").select("key", "task_id", (F.col("i") + 1).alias("place"), "n_finished")
