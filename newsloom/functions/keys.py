"""Identity keys of articles, titles, events and signatures. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def article_id(url: Column) -> Column:
    """Trimmed, without trailing slashes, lower case; scheme, www and query stay."""
    return _digest(F.lower(F.regexp_replace(F.trim(url), "/+$", "")))


def dedup_url(url: Column) -> Column:
    """Scheme, www, query and fragment do not count; the empty url has the empty key."""
    bare = F.regexp_replace(F.trim(url), "/+$", "")
    bare = F.regexp_replace(bare, r"^https?://(www\.)?", "")
    bare = F.lower(F.regexp_replace(bare, r"[?#].*$", ""))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(_digest(bare))


def cache_url(url: Column) -> Column:
    """Scheme, www, fragment and tracking parameters do not count."""
    bare = F.lower(F.regexp_replace(F.trim(url), "/+$", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"^https?://(www\.)?", ""), r"#.*$", "")
    bare = F.regexp_replace(bare, r"([?&])(utm_[^=&]*|ref|fbclid|gclid|source|mc_[^=&]*)=[^&]*", r"$1")
    return _digest(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"&+", "&"), r"\?&", "?"), r"[?&]+$", ""))


def signal_url(url: Column) -> Column:
    """Host and path in lower case; port, query and fragment do not count, www does."""
    host = F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    return F.concat(F.lower(host), F.lower(F.regexp_replace(path, "/+$", "")))


def title_key(title: Column) -> Column:
    """Case and white space do not count; ASCII white space, so that all engines agree."""
    return _digest(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[ \t\n\r\f\x0b]+", ""))


def signature_key(signature: Column) -> Column:
    """Sorted distinct tokens of more than one character; null unless there are two in six characters."""
    clean = F.regexp_replace(F.lower(signature), r"[^\p{L}\p{N}_]+", " ")
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.trim(clean), " +"), lambda t: F.length(t) > 1)))
    return F.when((F.length(signature) >= 6) & (F.size(tokens) >= 2), F.concat_ws(" ", tokens))


#: fixed values: verbs of a signature by kind of action, and names by the entity they mean
VERBS = {
    "publish": ("release", "launch", "announce", "unveil", "introduce", "reveal", "ship", "roll-out", "rollout", "debut", "preview", "demo", "publish", "upload"),
    "acquisition": ("acquire", "buy", "purchase", "merge", "takeover"),
    "funding": ("fund", "fundraise", "raise", "invest", "close", "secure"),
    "partnership": ("partner", "collaborate", "team-up", "team"),
    "opensource": ("open-source", "open"),
    "hiring": ("hire", "appoint", "join", "leave", "depart", "fire", "resign"),
    "legal": ("sue", "settle", "fine", "ban"),
    "strategy": ("pivot", "restructure"),
}
ENTITIES = {
    "openai": ("open-ai",),
    "google": ("google-deepmind", "deepmind", "alphabet"),
    "meta": ("meta-ai", "facebook", "fair"),
    "microsoft": ("msft",),
    "amazon": ("aws",),
    "mistral": ("mistral-ai",),
    "huggingface": ("hugging-face", "hf"),
    "xai": ("x-ai",),
    "deepseek": ("deep-seek",),
    "bytedance": ("字节", "字节跳动"),
    "alibaba": ("阿里", "阿里巴巴"),
    "baidu": ("百度",),
    "tencent": ("腾讯",),
    "moonshot": ("月之暗面",),
    "zhipu": ("智谱",),
}


def _among(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*[F.lit(x) for name, words in table.items() for w in words for x in (w, name)])


def entity_action_key(signature: Column) -> Column:
    """'entity|action' of a signature: its first word and the first known verb among the next four; null without one."""
    words = F.regexp_extract_all(F.lower(F.trim(signature)), F.lit(r"[\p{L}\p{N}_-]+"), 0)
    entity = F.coalesce(F.try_element_at(_among(ENTITIES), F.get(words, F.lit(0))), F.get(words, F.lit(0)))
    actions = F.filter(F.transform(F.slice(words, 2, 4), lambda w: F.try_element_at(_among(VERBS), w)), lambda a: a.isNotNull())
    return F.when(F.size(actions) > 0, F.concat_ws("|", entity, F.get(actions, F.lit(0))))


def judgment_key(date: Column, shift: Column, title: Column) -> Column:
    return F.concat_ws("|", F.coalesce(date, F.lit("")), F.coalesce(shift, F.lit("")), F.coalesce(title, F.lit("")))
