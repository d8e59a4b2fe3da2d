"""Names of works as Column expressions: normalising, episodes, creator tags, natural order, sizes.

Everything is built from JVM-side functions; there is no Python UDF. Regular expressions use
(?U) so that digits and white space are those of Unicode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bracket variants and what they become.
BRACKETS_FROM = "【】［］「」『』（）"
BRACKETS_TO = "[][][][]()"

# Language tags and their codes.
LANGUAGE_CODES = {
    "chinese": "chn", "china": "chn", "chs": "chn", "cht": "chn", "chn": "chn", "cn": "chn", "中文": "chn", "中国语": "chn",
    "english": "eng", "eng": "eng", "en": "eng",
}

# Tags that carry no information.
DROPPED_TAGS = [
    "decensored", "decensor", "uncensored", "censored", "censorship", "digital", "digital ver", "digital version",
    "scan", "scanned", "scanlation", "complete", "completed", "ongoing", "end", "raw", "pixiv", "twitter", "fanbox",
    "patreon", "ai generated", "ai-generated", "dl", "dl版", "mtl",
]

# Parts of a tag that name a translation team.
TRANSLATOR_MARKERS = ["汉化", "漢化", "翻译", "翻訳", "嵌字", "扫图", "掃圖", "修图", "修圖", "校对", "校對"]

# Markers between a title and an episode number.
EPISODE_MARKERS = ["_episode_", "_ep_", "_chapter_", "_ch_", "_vol_"]

# Parts of a tag that make it metadata, not a creator.
METADATA_MARKERS = [
    "chinese", "english", "chn", "eng", "cn", "en", "digital", "complete", "ongoing", "pixiv", "twitter",
    "ai generated", "中国", "翻译", "翻訳", "汉化", "漢化", "dl版",
]

# Bracket pairs of leading tags.
TAG_PAIRS = [("[", "]"), ("(", ")"), ("（", "）"), ("【", "】"), ("［", "］")]

#: Episode patterns in order of precedence: prefix, number, suffix.
EPISODE_PATTERNS = [rf"(?iuU)^(.+?{m})(\d+)()$" for m in EPISODE_MARKERS] + [rf"(?U)^(.+{m})(\d+)()$" for m in (" ", "-", "#")] + [r"(?U)^(.+第)(\d+)([话話集卷])$"]
MERGED_RANGE = r"(?iuU)(?:" + "|".join(EPISODE_MARKERS) + r"|\s)\d+to\d+\s*$"
DELIMITED = r"(\[[^\]]*\]|\([^)]*\))"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def fold(x: Column) -> Column:
    """Case folding: lower case, and ß as ss."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def collapse_spaces(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" ."))


def remove_invalid(x: Column) -> Column:
    """Without characters that file systems reject, and without a copy number at the end."""
    x = F.regexp_replace(strip(x), r'[<>:"/\\|?*]', "")
    return strip(F.regexp_replace(x, r"(?U)\(\s*\d+\s*\)\s*$", ""))


def remove_noise(x: Column) -> Column:
    for word in ("copy", "duplicate"):
        x = F.regexp_replace(x, rf"(?iuU)(?:^|\s){word}(?:\s|$)", " ")
    return x


def bracket_characters(x: Column) -> Column:
    return F.translate(x, BRACKETS_FROM, BRACKETS_TO)


def bracket_spacing(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?U)(?<=[^(\[\s])([(\[])", " $1")
    return F.regexp_replace(x, r"(?U)([)\]])(?=[^)\](\[\s])", "$1 ")


def strip_tag_suffix(tag: Column) -> Column:
    return F.regexp_replace(tag, r"(?iuU)(?:\s+(?:version\.?|ver\.?|版))+$", "")


def language_code(tag: Column) -> Column:
    codes = F.create_map(*[F.lit(v) for pair in LANGUAGE_CODES.items() for v in pair])
    return F.coalesce(codes[fold(tag)], codes[fold(strip_tag_suffix(tag))])


def is_dropped_tag(tag: Column) -> Column:
    return fold(tag).isin(DROPPED_TAGS) | fold(strip_tag_suffix(tag)).isin(DROPPED_TAGS) | tag.rlike("|".join(TRANSLATOR_MARKERS))


def tag_content(tag: Column) -> Column:
    """The tag's normal text; null if it should go."""

    def normal(tag: Column) -> Column:
        other = F.when(~is_dropped_tag(tag), fold(strip_tag_suffix(tag)))
        return F.when(tag != "", F.coalesce(language_code(tag), other))

    return bound(strip(tag), normal)


def _around_tags(x: Column, outside, inside) -> Column:
    """Apply one function to the text between delimited tags and another to the tags."""
    texts, tags = F.split(x, DELIMITED, -1), F.regexp_extract_all(x, F.lit(DELIMITED), F.lit(0))
    tags = F.concat(tags, F.array(F.lit("")))
    return F.array_join(F.zip_with(texts, tags, lambda t, g: F.concat(outside(t), F.when(g == "", "").otherwise(inside(g)))), "")


def delimited_tags(x: Column) -> Column:
    def tag(g: Column) -> Column:
        text = tag_content(F.substring(g, F.lit(2), F.length(g) - 2))
        return F.when(text.isNull(), " ").otherwise(F.concat(F.substring(g, 1, 1), text, F.right(g, F.lit(1))))

    return _around_tags(x, lambda t: t, tag)


_WORD = r"(?s)^([^A-Za-z]*)([A-Za-z])(.*)$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def title_word(w: Column) -> Column:
    """The first ASCII letter in upper case, those after it in lower case."""
    cased = F.concat(F.regexp_extract(w, _WORD, 1), F.upper(F.regexp_extract(w, _WORD, 2)), F.translate(F.regexp_extract(w, _WORD, 3), _UPPER, _LOWER))
    return F.when(w.rlike(_WORD), cased).otherwise(w)


def title_text(x: Column) -> Column:
    token = lambda t: F.array_join(F.transform(F.split(t, "_", -1), title_word), "_")
    return F.array_join(F.transform(F.split(x, " ", -1), token), " ")


def title_episode_aware(x: Column) -> Column:
    """Title case that leaves an episode's marker and number as they are (the marker in lower case)."""
    prefix = F.coalesce(*[F.when(x.rlike(p), F.regexp_extract(x, p, 1)) for p in EPISODE_PATTERNS], x)

    def cased(p: Column) -> Column:
        low = fold(p)
        marker = F.coalesce(*[F.when((p != x) & low.endswith(m), F.lit(m)) for m in EPISODE_MARKERS], F.lit(""))
        head = bound(marker, lambda m: F.concat(title_text(F.substring(p, F.lit(1), F.length(p) - F.length(m))), m))
        return F.concat(head, F.substring(x, F.length(p) + 1, F.length(x)))

    return bound(prefix, cased)


def title_outside_tags(x: Column) -> Column:
    def text(t: Column) -> Column:
        cased = F.concat(F.regexp_extract(t, "^ *", 0), bound(strip(t), title_episode_aware), F.regexp_extract(t, " *$", 0))
        return F.when(t.rlike(r"(?U)^\s*$") | t.startswith("(") | t.startswith("["), t).otherwise(cased)

    return _around_tags(x, text, lambda g: g)


def bound(x: Column, then) -> Column:
    """then(x) with x computed once, however often `then` uses it."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def standard_name(name: Column) -> Column:
    """A clean folder name: the whole chain, or the stripped name if nothing is left."""
    steps = [remove_invalid, remove_noise, bracket_characters, bracket_spacing, collapse_spaces, delimited_tags, title_outside_tags, collapse_spaces]
    done = reduce(bound, steps, name)
    return bound(done, lambda x: F.when(x == "", strip(name)).otherwise(x))


def stem(name: Column) -> Column:
    """The name without its last suffix, as of a file."""
    return F.when(name.rlike(r"(?s)^.+\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def suffix(name: Column) -> Column:
    return F.when(name.rlike(r"(?s)^.+\.[^.]+$"), F.lower(F.regexp_extract(name, r"\.[^.]+$", 0))).otherwise("")


def standard_folder_name(kind: Column, name: Column) -> Column:
    return standard_name(F.when(kind == "folder", name).otherwise(stem(name)))


_WIDE = "０１２３４５６７８９"


def parse_episode(name: Column) -> Column:
    """struct(prefix, suffix, episode), null if the name is no single episode."""
    number = lambda p: F.translate(F.regexp_extract(name, p, 2), _WIDE, "0123456789").try_cast("long")
    parts = [F.when(name.rlike(p), F.struct(F.regexp_extract(name, p, 1).alias("prefix"), F.regexp_extract(name, p, 3).alias("suffix"), number(p).alias("episode"))) for p in EPISODE_PATTERNS]
    return F.when(~name.rlike(MERGED_RANGE), F.coalesce(*parts))


def merged_name(prefix: Column, start: Column, end: Column, ending: Column) -> Column:
    return standard_name(F.concat(prefix, start.cast("string"), F.lit("to"), end.cast("string"), ending))


_TAG = "|".join(rf"\{a}[^\{b}]*\{b}" if a in "[(" else f"{a}[^{b}]*{b}" for a, b in TAG_PAIRS)
_LEADING = rf"(?U)^\s*(?:(?:{_TAG})\s*)*"


def leading_tags(name: Column) -> Column:
    """Texts of the tags a name starts with."""
    run = F.regexp_extract(name, _LEADING, 0)
    return F.transform(F.regexp_extract_all(run, F.lit(f"({_TAG})"), F.lit(0)), lambda t: strip(F.substring(t, F.lit(2), F.length(t) - 2)))


def is_metadata(tag: Column, whole_words: bool = False) -> Column:
    markers = "|".join(METADATA_MARKERS)
    return fold(tag).rlike(rf"(?U)\b(?:{markers})\b" if whole_words else markers)


def creator_tag(name: Column, whole_words: bool = False) -> Column:
    """The first leading tag that is no metadata; an empty tag ends the search."""
    tags = leading_tags(name)
    empty = F.array_position(tags, "")
    tags = F.when(empty > 0, F.slice(tags, F.lit(1), (empty - 1).cast("int"))).otherwise(tags)
    return F.get(F.filter(tags, lambda t: ~is_metadata(t, whole_words)), 0)


def title_without_tags(name: Column) -> Column:
    rest = strip(F.regexp_replace(strip(name), _LEADING, ""))
    return F.when(rest == "", strip(name)).otherwise(rest)


def tagged_name(name: Column, creator: Column) -> Column:
    return F.concat(F.lit("["), creator, F.lit("] "), title_without_tags(name))


def confidence(distance: Column, ratio: Column, samples: Column, margin: Column, threshold: int) -> Column:
    return (
        F.when((distance <= max(8, threshold - 4)) & (ratio >= 0.6) & (samples >= 5) & (margin >= 2), "high")
        .when((distance <= threshold) & (ratio >= 0.45) & (margin >= 1.5), "medium")
        .when((distance <= threshold) & (ratio >= 0.35), "low")
        .otherwise("none")
    )


def natural_key(name: Column) -> Column:
    """An orderable key in which runs of digits count as numbers; ties by the name."""
    parts = F.regexp_extract_all(F.concat(F.lower(name), F.lit("|")), F.lit(r"(\D*)(\d*)"), F.lit(0))
    key = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^\D*", 0).alias("text"), F.regexp_extract(x, r"\d*$", 0).try_cast("decimal(38,0)").alias("number")))
    return F.struct(key.alias("parts"), name.alias("name"))


def cleanliness(name: Column, path: Column) -> Column:
    """struct(noise, length, odd characters, path) of a name's stem: less is cleaner."""
    s = stem(name)
    noise = reduce(lambda a, b: a + b, [F.regexp_count(s, F.lit(p)) for p in (r"(?U)\(\s*\d+\s*\)", r"(?iuU)\bcopy\b", r"(?iuU)\bduplicate\b")])
    odd = F.length(F.regexp_replace(s, r"[\p{L}\p{N} \-_.]", ""))
    return F.struct(noise.alias("noise"), F.length(s).alias("length"), odd.alias("odd"), F.lower(path).alias("path"))


def format_size(n: Column) -> Column:
    """Bytes in units of 1024: whole bytes, else two places; null is 0 B."""
    units = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]
    x = F.coalesce(n.cast("double"), F.lit(0.0))
    out = F.format_string("%.2f EB", x / float(1024**6))
    for k in range(5, 0, -1):
        out = F.when(F.abs(x) < float(1024 ** (k + 1)), F.format_string(f"%.2f {units[k]}", x / float(1024**k))).otherwise(out)
    return F.when(F.abs(x) < 1024, F.concat(x.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def prefixed_page(episode: Column, name: Column) -> Column:
    return F.format_string("e%02d_%s", episode, name)


def scale_for_budget(full: Column, most: Column) -> Column:
    """Linear scale at which an image of `full` bytes is likely to fit `most` bytes."""
    return F.when(full <= 0, 1.0).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.sqrt(most / full) * 0.95)))


def page_budget(original: Column, cap_mb: float = 0.0, ratio: float = 2.0) -> Column:
    """Most bytes of a converted page: twice the original, the cap, 1 KiB at least, 512 KiB if neither is known."""
    own = F.when(original > 0, F.greatest((original * ratio).cast("long"), F.lit(1024)))
    capped = F.lit(max(int(cap_mb * (1 << 20)), 1024) if cap_mb > 0 else None).cast("long")
    return F.coalesce(F.least(own, capped), F.lit(512 << 10).cast("long"))
