"""What came of asking a model: attempts at one answer, resources tried in turn, settings of older versions, finished tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import strip
from leafmill.operators.settings import CONCURRENCY, CONCURRENCY_ELSE

#: Attempts at a segment, seconds that a local resource gets while others wait behind it, and finished tasks that are shown (fixed values).
TRIES, FAST_SECONDS, SHOWN = 3, 12.0, 50
#: What is added to a prompt that is sent again, by what was wrong with the answer (fixed values).
NO_JSON = "\n\n上次输出不是合法 JSON，请只输出一个完整 JSON 对象，不要任何解释文字；bullets 须为 {{label, body}} 对象数组。"
NOT_GOOD = ("\n\n上次输出不符合要求：", "。bullets 每条 body 须充实说明，禁止只写标签；follow_ups 须基于本段已覆盖内容。")
SHORT_FORM = '\n\n上次输出不是合法 JSON。请只输出 {{"sentences":["…"],"bullets":[{{"label":"…","body":"…"}}],"follow_ups":["…"]}}，不要其他文字。'
#: Profiles in the order in which their settings count, and resources that are known by their provider's name (fixed values).
PROFILES = ("chat", "summarize", "translate")
BUILT_IN = ("ollama", "openai", "openrouter", "cursor", "aiping")


def settled(attempts: DataFrame, *key: str, tries: int = TRIES, minimal: bool = False) -> DataFrame:
    """attempts(key, attempt, problem, detail, duration_s), attempt from 1 -> key, won, attempts, duration_s, problem, detail, suffix.

    The first attempt without a problem wins and ends it; what comes after that, or after the last try, doesn't count. Without
    a winner problem and detail are those of the last attempt, and suffix is what the next prompt has to say besides, null if there is no next. A
    segment has few attempts that count, so that they fit in one row.
    """
    made = attempts.filter(F.col("attempt").between(1, tries)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("attempt", "problem", "detail", "duration_s"))).alias("made"))
    zero = F.struct(F.lit(None).cast("int").alias("won"), F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit(None).cast("string").alias("problem"), F.lit(None).cast("string").alias("detail"))

    def step(a: Column, x: Column) -> Column:
        now = F.struct(
            F.when(x["problem"].isNull(), x["attempt"]).cast("int").alias("won"), (a["n"] + 1).alias("n"), (a["total"] + F.coalesce(x["duration_s"], F.lit(0.0))).alias("total"),
            x["problem"].alias("problem"), F.when(x["problem"].isNotNull(), x["detail"]).alias("detail"),
        )
        return F.when(a["won"].isNotNull(), a).otherwise(now)

    folded = made.select(*key, F.aggregate("made", zero, step).alias("r"))
    again = F.col("r.won").isNull() & (F.col("r.n") < tries)
    said = F.lit(SHORT_FORM) if minimal else F.when(F.col("r.problem") == "no JSON", NO_JSON).otherwise(F.concat(F.lit(NOT_GOOD[0]), F.coalesce("r.detail", "r.problem"), F.lit(NOT_GOOD[1])))
    return folded.select(*key, "r.won", F.col("r.n").alias("attempts"), F.round("r.total", 2).alias("duration_s"), "r.problem", "r.detail", F.when(again, said).alias("suffix"))


def routed(calls: DataFrame, chains: DataFrame, outcomes: DataFrame, local: str = "ollama", fast: float = FAST_SECONDS) -> DataFrame:
    """calls(call_id, profile), chains(profile, pos, resource, provider, configured), outcomes(call_id, resource, busy, seconds, error)
    -> call_id, resource (that answered), place (its pos), retried, tried, error.

    Resources that are configured are tried in order until one answers. While others wait behind it, a busy resource is passed over and a
    slow local one given up; summaries wait instead. If none answers, the local resource is tried once more, without these limits, if it was given
    up or not tried at all. error is the last one; a call without any resource has none that answers. An outcome that isn't there is an answer.
    """
    last = F.max(F.when(F.col("configured"), F.col("pos"))).alias("last")
    chain = chains.join(chains.groupBy("profile").agg(last), "profile")
    met = calls.select("call_id", "profile").join(chain, "profile").join(outcomes, ["call_id", "resource"], "left")
    waits = (F.col("pos") < F.col("last")) & (F.col("profile") != "summarize")
    is_local, seconds = F.col("provider") == local, F.coalesce("seconds", F.lit(0.0))
    given_up = F.col("configured") & waits & is_local & ~F.coalesce("busy", F.lit(False)) & (seconds > fast)
    failure = F.when(waits & F.coalesce("busy", F.lit(False)), "busy").when(given_up, "timeout").otherwise(F.col("error"))
    tried = met.select("*", failure.alias("failure"), given_up.alias("given_up"))
    pos, ok = F.col("pos"), F.col("configured") & F.col("failure").isNull()
    folded = tried.groupBy("call_id").agg(
        F.min_by(F.struct("resource", "pos"), F.when(ok, pos)).alias("answer"), F.min(F.when(ok, pos)).alias("ok_at"),
        F.max_by("failure", F.when(F.col("configured"), pos)).alias("last_failure"), F.array_sort(F.collect_list(F.when(F.col("configured"), F.struct("pos", "resource")))).alias("order"),
        F.min_by(F.struct("resource", "pos", "error", "configured", "given_up"), F.when(is_local, pos)).alias("spare"), F.max("given_up").alias("any_given_up"),
    )
    again = F.col("ok_at").isNull() & F.col("spare").isNotNull() & (F.col("any_given_up") | ~F.col("spare.configured"))
    saved = again & F.col("spare.error").isNull()
    answer = F.when(F.col("ok_at").isNotNull(), F.col("answer")).when(saved, F.struct("spare.resource", "spare.pos"))
    upto = F.filter("order", lambda x: F.col("ok_at").isNull() | (x["pos"] <= F.col("ok_at")))
    error = F.when(answer.isNull(), F.when(again, F.col("spare.error")).otherwise(F.col("last_failure")))
    found = folded.select("call_id", answer.alias("answer"), again.alias("retried"), F.transform(upto, lambda x: x["resource"]).alias("tried"), error.alias("error"))
    none = F.array().cast("array<string>")
    return calls.select("call_id").join(found, "call_id", "left").select("call_id", "answer.resource", F.col("answer.pos").alias("place"), F.coalesce("retried", F.lit(False)).alias("retried"), F.coalesce("tried", none).alias("tried"), "error")


PROFILE = "STRUCT<provider: STRING, base_url: STRING, model: STRING, priority: ARRAY<STRING>>"
SETTINGS = f"STRUCT<chat: {PROFILE}, summarize: {PROFILE}, translate: {PROFILE}, job_concurrency: MAP<STRING, INT>, resources: ARRAY<STRUCT<id: STRING, provider: STRING, base_url: STRING, model: STRING, concurrency: INT>>>"


def _slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")


def resource_id(provider: Column, base_url: Column) -> Column:
    """The id that a provider of old settings gets: a known one its name, others name and host."""
    name, url = F.lower(strip(provider)), F.coalesce(base_url, F.lit(""))
    slug = F.coalesce(F.nullif(_slug(name), F.lit("")), F.lit("custom"))
    host = _slug(F.substring(F.substring_index(F.regexp_replace(url, "/+$", ""), "//", -1), 1, 24))
    return F.when(name.isin(*BUILT_IN), name).when((url != "") & (host != ""), F.concat(slug, F.lit("-"), host)).otherwise(slug)


def migrated(settings: DataFrame, presets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """settings(settings_id, raw), presets(resource_id, provider, base_url, model, concurrency)
    -> resources(settings_id, resource_id, provider, base_url, model, concurrency) and routes(settings_id, profile, priority).

    Settings of the old form name a provider for each profile: each becomes a resource beside the presets, the last
    profile's address and model counting, and the profile's route. Old numbers of jobs at once go to the resources that have none of their own.
    Settings that can't be read have neither.
    """
    s = settings.select("settings_id", F.from_json("raw", SETTINGS).alias("s")).filter("s IS NOT NULL")
    s = s.withColumn("old", F.col("s.chat.provider").isNotNull() & F.col("s.chat.priority").isNull())
    blocks = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(p).alias("profile"), F.col(f"s.{p}.provider").alias("provider"), F.col(f"s.{p}.base_url").alias("base_url"), F.col(f"s.{p}.model").alias("model"), F.col(f"s.{p}.priority").alias("priority")) for i, p in enumerate(PROFILES)]))
    named = s.select("settings_id", "old", blocks.alias("b")).select("settings_id", "old", "b.*").withColumn("resource_id", resource_id(F.col("provider"), F.col("base_url")))
    legacy = named.filter("old AND provider IS NOT NULL")
    filled = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("pos"))).alias(c)
    own = legacy.groupBy("settings_id", "resource_id").agg(F.max_by("provider", "pos").alias("provider"), filled("base_url"), filled("model"))
    preset = s.filter("old").select("settings_id").crossJoin(F.broadcast(presets))  # presets are a handful of rows
    o, p = own.alias("o"), preset.alias("p")
    both = o.join(p, ["settings_id", "resource_id"], "full").select("settings_id", "resource_id", *[F.coalesce(f"o.{c}", f"p.{c}").alias(c) for c in ("provider", "base_url", "model")], F.col("p.concurrency").alias("concurrency"))
    new = s.filter("NOT old").select("settings_id", F.explode("s.resources").alias("r")).select("settings_id", F.col("r.id").alias("resource_id"), "r.provider", "r.base_url", "r.model", "r.concurrency")
    jobs = s.select("settings_id", F.col("s.job_concurrency").alias("jobs"))
    name = F.lower(strip(F.coalesce("provider", F.lit(""))))
    of = F.when(name.isin(*CONCURRENCY), name).otherwise("cloud")
    default = F.coalesce(*[F.when(name == k, n) for k, n in CONCURRENCY.items()], F.lit(CONCURRENCY_ELSE))
    number = F.greatest(F.lit(1), F.coalesce(F.try_element_at("jobs", of), default))
    full = both.unionByName(new).join(jobs, "settings_id").withColumn("concurrency", F.when((F.coalesce("concurrency", F.lit(0)) == 0) & F.col("jobs").isNotNull(), number).otherwise(F.col("concurrency")))
    routes = named.select("settings_id", "profile", F.when(F.col("old") & F.col("provider").isNotNull(), F.array("resource_id")).when(~F.col("old"), F.col("priority")).alias("priority")).filter("priority IS NOT NULL")
    return full.drop("jobs"), routes


def recent(finished: DataFrame, key: str, limit: int = SHOWN) -> DataFrame:
    """finished(key, task_id, seq) -> the last tasks of each key with their place, and how many there have been in all.

    Spark keeps the first few of each key before it deals them out, so that a key with many tasks meets no single task.
    """
    order = Window.partitionBy(key).orderBy(F.desc("seq"))
    last = finished.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return last.join(finished.groupBy(key).agg(F.count(F.lit(1)).alias("n_finished")), key)
