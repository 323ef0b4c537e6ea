"""Text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends; trim() knows the ASCII space only."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def bare(x: Column) -> Column:
    """strip(x) for what costs nothing to evaluate again, such as a lambda's variable: the pattern runs only where an end is white space."""
    return F.when(F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(r"(?U)\s"), strip(x)).otherwise(x)


def first_filled(*options: Column) -> Column:
    """The first that isn't null or blank, stripped."""
    return F.coalesce(*[F.nullif(strip(o), F.lit("")) for o in options])


def strip_html(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"(?U)\s+", " "))


def cut(x: Column, limit: int) -> Column:
    """At most limit characters, the last an ellipsis if any were lost; a limit of 0 cuts nothing."""
    if limit <= 0:
        return x
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit - 1), F.lit("…")))


def html_to_text(x: Column) -> Column:
    """Text of an HTML page: breaks and paragraphs as line breaks, no scripts, styles or tags; basic entities decoded."""
    x = F.regexp_replace(x, r"(?is)<script\b.*?</script>|<style\b.*?</style>", "")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"(?i)</(?:p|h[1-6])>", "\n\n")
    x = F.regexp_replace(x, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(x, "[ \t]+\n", "\n")
    return strip(F.regexp_replace(x, "\n{3,}", "\n\n"))


def sentences(x: Column) -> Column:
    """Sentences that end in a full-width mark, stripped, without empty ones."""
    parts = once(x, lambda y: F.split(bare(y), r"(?<=[。！？])(?U)\s*"))
    return F.filter(F.transform(parts, bare), lambda s: s != "")


def ensure_mark(x: Column) -> Column:
    marked = lambda y: F.when((y == "") | F.substring(y, -1, 1).isin(*"。！？.!?"), y).otherwise(F.concat(y, F.lit("。")))
    return once(x, lambda y: once(bare(y), marked))


def ascii_nocase(x: Column) -> Column:
    """A sort key that ignores the case of ASCII letters only."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a subdomain of the other."""
    return (a != "") & (b != "") & ((a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)))


def address_key(url: Column) -> Column:
    """An address without fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def article_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def body_is_good(text: Column, expected_words: Column | None = None, floor: int = 500) -> Column:
    """Long enough: the floor, and three tenths of the expected words if those are known."""
    least = F.lit(floor)
    if expected_words is not None:
        least = F.when(expected_words > 0, F.greatest(F.lit(floor), F.floor(expected_words * 3 / 10))).otherwise(least)
    return F.length(strip(F.coalesce(text, F.lit("")))) >= least


def duration(seconds: Column) -> Column:
    """12s, 2m, 2m 5s."""
    s = F.round(seconds).cast("long")
    m, rest = F.floor(s / 60), s % 60
    return F.when(s < 60, F.concat(s, F.lit("s"))).when(rest == 0, F.concat(m, F.lit("m"))).otherwise(F.concat(m, F.lit("m "), rest, F.lit("s")))


def safe_file_name(x: Column) -> Column:
    return F.regexp_replace(x, r'[/\\?%*|"<>:]', "_")


def openai_base(url: Column) -> Column:
    """A service address without trailing slashes, ending in /v1."""
    bare = F.regexp_replace(strip(url), "/+$", "")
    bare = F.regexp_replace(bare, "/chat/completions$", "")
    return F.when(bare.rlike("/v[0-9]+$"), bare).otherwise(F.concat(bare, F.lit("/v1")))


def hrefs(page: Column) -> Column:
    """Addresses of a page's links, in order, repeated ones too."""
    return F.regexp_extract_all(page, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)"""), F.lit(1))


def resolved(link: Column, base: Column) -> Column:
    """A link against its page's address: absolute ones as they are, rooted ones on its host, others beside it; null for other schemes."""
    origin = F.regexp_extract(base, r"^(?i)(https?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*", 0), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(link.rlike("^(?i)https?://"), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def _streamed(body: Column) -> Column:
    """The data lines of an event stream, up to its end."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.startswith("data:"))
    data = F.transform(lines, lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    end = F.array_position(data, "[DONE]").cast("int")
    return F.when(end > 0, F.slice(data, F.lit(1), end - 1)).otherwise(data)


def stream_deltas(body: Column) -> Column:
    """The pieces of an event stream, joined."""
    return F.array_join(F.transform(_streamed(body), lambda d: F.get_json_object(d, "$.choices[0].delta.content")), "")


def stream_usage(body: Column) -> Column:
    """prompt_tokens, completion_tokens, total_tokens as the last data line tells that tells any; a missing total is the sum of both."""
    told = F.filter(F.transform(_streamed(body), lambda d: F.get_json_object(d, "$.usage")), lambda u: u.isNotNull())
    number = lambda name: F.get_json_object(F.try_element_at(told, F.lit(-1)), f"$.{name}").cast("long")
    prompt, completion = number("prompt_tokens"), number("completion_tokens")
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.coalesce(number("total_tokens"), prompt + completion).alias("total_tokens"))


def is_embedding_model(name: Column) -> Column:
    return F.lower(name).rlike("embed|bge-|e5-|gte-|minilm")


def same_model(a: Column, b: Column) -> Column:
    """Equal but for the tag of the newest version."""
    return F.regexp_replace(a, ":latest$", "") == F.regexp_replace(b, ":latest$", "")


#: What is shown in place of a secret.
MASK = "********"


def masked(secret: Column) -> Column:
    return F.when(secret.isNotNull() & (secret != ""), F.lit(MASK))


def once(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row: a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def attachment(name: Column) -> Column:
    """The header that names a downloaded file: in ASCII, and in full as percent-encoded UTF-8."""
    plain = F.regexp_replace(F.regexp_replace(name, r"[^\x00-\x7F]", ""), r"^[._\- ]+|[._\- ]+$", "")
    full = F.url_encode(name)
    for code, char in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        full = F.replace(full, F.lit(code), F.lit(char))
    return F.concat(F.lit('attachment; filename="'), F.coalesce(F.nullif(plain, F.lit("")), F.lit("summary.md")), F.lit("\"; filename*=UTF-8''"), full)


def has_cjk(x: Column) -> Column:
    return x.rlike("[一-鿿]")


def is_local(url: Column) -> Column:
    """Whether an address is this machine's."""
    return host(url).isin("localhost", "127.0.0.1", "::1", "[::1]")


def event_text(payload: Column) -> Column:
    """An event as a listener of an event stream gets it; payload is a struct."""
    return F.concat(F.lit("data: "), F.to_json(payload), F.lit("\n\n"))
