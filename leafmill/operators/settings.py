"""Resources, models and prompts: choices derived from tables of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import first_filled, is_embedding_model, same_model, strip

#: Jobs at once by provider, for want of a setting, and of all others (fixed values).
CONCURRENCY, CONCURRENCY_ELSE = {"ollama": 1, "cursor": 8}, 4
WEB_PROVIDERS = ("ddgs", "tavily", "wikipedia")
#: Characters of a segment by provider (fixed values).
BUDGETS, BUDGET_ELSE = {"ollama": 2500, "openrouter": 3500}, 4000


def concurrency(provider: Column, own: Column) -> Column:
    """Jobs at once of a resource: its own number if above 0, else its provider's."""
    chain = F.lit(CONCURRENCY_ELSE)
    for name, n in CONCURRENCY.items():
        chain = F.when(F.lower(F.trim(provider)) == name, n).otherwise(chain)
    return F.when(own > 0, own).otherwise(chain)


def configured(provider: Column, key: Column) -> Column:
    """Local resources always, others with a key."""
    return (provider == "ollama") | (F.coalesce(strip(key), F.lit("")) != "")


def web_provider(choice: Column, key: Column) -> Column:
    """The provider of web search: what isn't known, and one that lacks its key, is the default."""
    name = F.lower(F.coalesce(strip(choice), F.lit("")))
    known = F.when(name.isin(*WEB_PROVIDERS), name).otherwise(F.lit(WEB_PROVIDERS[0]))
    return F.when((known == "tavily") & (F.coalesce(strip(key), F.lit("")) == ""), F.lit(WEB_PROVIDERS[0])).otherwise(known)


def with_fallback(order: DataFrame) -> DataFrame:
    """order(profile, ids) where translate, if it has no chain of its own, takes the one of summarize."""
    spare = order.filter("profile = 'summarize'").select(F.col("ids").alias("spare"))
    own = order.filter("profile = 'translate' AND ids IS NOT NULL")
    lent = spare.select(F.lit("translate").alias("profile"), F.col("spare").alias("ids")).join(own.select("profile"), "profile", "left_anti")
    return order.filter("ids IS NOT NULL").unionByName(lent)


def chain_facts(chains: DataFrame) -> DataFrame:
    """chains(profile, pos, provider, concurrency) -> of each profile whether its first or any resource is local, and its most jobs at once."""
    first = F.min_by("provider", "pos")
    most = F.greatest(F.lit(1), F.max(concurrency(F.col("provider"), F.col("concurrency"))))
    return chains.groupBy("profile").agg((first == "ollama").alias("local_first"), (first != "ollama").alias("cloud_first"), F.max(F.col("provider") == "ollama").alias("uses_local"), most.alias("most_at_once"))


def installed_match(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """wanted(machine, model), installed(machine, name, pos) -> the first installed name that is the model, but for the tag of the newest version."""
    met = wanted.join(installed, "machine").filter(same_model(F.col("model"), F.col("name")))
    return met.groupBy("machine", "model").agg(F.min_by("name", "pos").alias("name"))


def chat_model(machines: DataFrame, installed: DataFrame, tiers: DataFrame) -> DataFrame:
    """machines(machine, ram, configured), installed(machine, name), tiers(tier, min_ram, model) -> model, adopted.

    The configured one if it is installed; else of the installed that are no embedding models the one
    of the machine's tier, the one of the nearest tier (the lower of two), or the first by name.
    """
    best = machines.join(F.broadcast(tiers), F.col("min_ram") <= F.col("ram"), "left").groupBy("machine", "ram", "configured").agg(F.max_by("tier", "min_ram").alias("own_tier"))  # a settings table, a handful of tiers
    names = installed.filter(F.coalesce("name", F.lit("")) != "").distinct()
    has = names.join(machines.select("machine", "configured"), "machine").groupBy("machine").agg(F.max(same_model(F.col("configured"), F.col("name"))).alias("there"))
    ranked = names.filter(~is_embedding_model(F.col("name"))).join(best, "machine").join(F.broadcast(tiers.select("tier", F.col("model").alias("tier_model"))), same_model(F.col("tier_model"), F.col("name")), "left")
    order = F.struct(F.coalesce(F.abs(F.col("tier") - F.coalesce("own_tier", F.lit(0))), F.lit(1 << 30)).alias("far"), F.coalesce("tier", F.lit(1 << 30)).alias("tier"), "name")
    picked = ranked.groupBy("machine").agg(F.min_by("name", order).alias("picked"))
    joined = best.join(has, "machine", "left").join(picked, "machine", "left")
    own = F.coalesce(F.col("there"), F.lit(False)) & first_filled(F.col("configured")).isNotNull()
    return joined.select("machine", F.when(own, F.col("configured")).otherwise(F.coalesce("picked", F.col("configured"))).alias("model"), (~own & F.col("picked").isNotNull()).alias("adopted"))


def prompts(base: DataFrame, own: DataFrame, clearable: tuple[str, ...]) -> DataFrame:
    """base(field, text), own(field, text) -> prompts: a text that isn't blank overrides; a clearable field that is blank or null is cleared."""
    o = own.select("field", F.col("text").alias("own"), F.lit(True).alias("given"))
    blank = F.coalesce(F.trim("own"), F.lit("")) == ""
    text = F.when(F.col("given").isNull(), F.col("text")).when(~blank, F.col("own")).when(F.col("field").isin(*clearable), None).otherwise(F.col("text"))
    return base.join(o, "field", "left").select("field", text.alias("text"))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A prompt with its placeholders filled in."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def missing_placeholders(template: Column, names: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, names)), lambda x: ~F.contains(template, F.concat(F.lit("{"), x, F.lit("}"))))


def budget(provider: Column, own: Column, override: int | None = None) -> Column:
    """target, max and min characters of a segment: an override, the resource's own number, or its provider's."""
    by_provider = F.lit(BUDGET_ELSE)
    for name, n in BUDGETS.items():
        by_provider = F.when(provider == name, n).otherwise(by_provider)
    target = F.lit(override) if override else F.when(own > 0, own).otherwise(by_provider)
    return F.struct(target.alias("target"), F.floor(target * 6 / 5).cast("int").alias("most"), F.floor(target * 3 / 5).cast("int").alias("least"))


def last_calls(calls: DataFrame) -> DataFrame:
    """calls(resource, profile, started, duration_ms, error) -> the last call of each resource."""
    record = F.struct("profile", "started", "duration_ms", F.col("error").isNull().alias("ok"), "error")
    return calls.groupBy("resource").agg(F.max_by(record, "started").alias("c")).select("resource", "c.*")


def metrics(provider: Column, model: Column, **numbers: Column) -> Column:
    """A map of what is set, as text."""
    given = {"provider": F.nullif(provider, F.lit("")), "model": F.nullif(model, F.lit(""))} | numbers
    return F.map_filter(F.create_map(*[x for k, v in given.items() for x in (F.lit(k), v.cast("string"))]), lambda k, v: v.isNotNull())


#: What a failure's text tells about its cause, in order (fixed values).
HINTS = (
    ("cursor base_url not set", "", "Cursor 需配置 OpenAI 兼容 Base URL（官方暂无原生 chat/completions endpoint）"),
    ("cursor api_key not set", "", "Cursor API Key 未配置"),
    ("base_url not set", "cursor base_url", "请在设置中配置对应资源的 Base URL"),
    ("api_key not set", "cursor api_key", "请在设置中配置对应资源的 API Key"),
)


def chain_failure(tried: Column, detail: Column) -> Column:
    """Why a whole chain failed: what was tried, the last error, and hints."""
    detail = F.coalesce(F.nullif(detail, F.lit("")), F.lit("未知错误"))
    hints = [F.when(F.contains(detail, F.lit(part)) & (~F.contains(detail, F.lit(unless)) if unless else F.lit(True)), F.lit(hint)) for part, unless, hint in HINTS]
    hints.append(F.when(F.contains(detail, F.lit("404")) & F.contains(detail, F.lit("Not Found")), F.lit("请检查 Base URL 是否正确（OpenRouter 应为 https://openrouter.ai/api/v1）")))
    told = F.array_join(F.array_compact(F.array(*hints)), "；")
    names = F.coalesce(F.nullif(F.array_join(tried, ", "), F.lit("")), F.lit("（无）"))
    return F.concat(F.lit("优先级链全部失败（已尝试："), names, F.lit("）："), detail, F.when(told != "", F.concat(F.lit("。"), told)).otherwise(""))


def default_feed(language: Column, chinese: str, other: str) -> Column:
    return F.when(F.lower(F.coalesce(language, F.lit(""))).startswith("zh"), chinese).otherwise(other)


def reachable(resources: DataFrame, runtime: DataFrame, probes: DataFrame) -> DataFrame:
    """runtime(resource, in_use) and probes(resource, ok, detail) side by side; one without the other has 0 or nothing."""
    joined = runtime.join(probes, "resource", "full_outer").join(resources.select("resource", F.lit(True).alias("known")).distinct(), "resource", "left")
    return joined.select("resource", F.coalesce("in_use", F.lit(0).cast("long")).alias("in_use"), "ok", "detail", F.coalesce("known", F.lit(False)).alias("known"))


def prompt_profile(facts: DataFrame, tries: int = 3, local_tries: int = 2) -> DataFrame:
    """chain_facts() of the profile summarize -> which prompt is used, how often it is tried, and the least length of a bullet (fixed values)."""
    kind = F.when(F.col("local_first"), "local").when(F.col("cloud_first"), "cloud").otherwise("full")
    return facts.select("profile", kind.alias("prompt"), F.when(kind == "local", local_tries).otherwise(tries).alias("tries"), F.when(kind == "full", 20).otherwise(12).alias("least_body"))


#: Characters of a segment that are sent to be translated (fixed value).
TRANSLATED_CHARS = 8000


def translation_input(text: Column) -> Column:
    return F.substring(text, 1, TRANSLATED_CHARS)
