"""Model numbers, names and brands: Column to Column, null-safe, inside generated code."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of collaborations, and words that mark a special edition with their synonyms.
COLLABS = (
    "travis scott", "supreme", "off-white", "off white", "sacai", "dior", "louis vuitton", "fragment", "union", "ambush", "stussy", "peaceminusone", "clot", "undercover",
    "comme des garcons", "cdg", "parra", "undefeated", "atmos", "j balvin", "cactus jack", "billie eilish", "tiffany", "트래비스 스캇", "슈프림", "오프화이트", "사카이", "디올",
    "프라그먼트", "유니온", "앰부쉬", "스투시", "유토피아", "캑터스", "언더커버", "피스마이너스원", "빌리 아일리시", "자크뮈스", "루이비통", "티파니", "파라", "클롯",
)
SUBTYPES = ("prm", "premium", "qs", "retro", "레트로", "se", "craft", "next", "nature", "lx", "flyknit", "react", "gore", "tex", "goretex", "acg")
SUBTYPE_SYNONYMS = {"prm": "premium", "레트로": "retro"}

#: Edges of a code. \b would take Hangul for a letter in one engine and not in another.
_EDGE, _END = "(?:^|[^A-Z0-9])", "(?:$|[^A-Z0-9])"
# The patterns of model codes.
#: Codes behind a slash, then codes anywhere; (pattern, groups joined with "-"). The first that fits wins.
SLASH_PATTERNS = ("^[A-Z]{1,3}[0-9]{3,5}-?[0-9]{2,4}", "^[0-9]{4}[A-Z][0-9]{3,4}-[0-9]{3}", "^[A-Z]{1,2}[0-9]{3,4}[A-Z0-9]{2,6}$")
MODEL_PATTERNS: tuple[tuple[str, str], ...] = (
    ("trail", "(LC[0-9]{7}|LD[0-9]{7}|L[0-9]{8})"),
    ("runner", "([0-9]{4}[A-Z][0-9]{3,4}-[0-9]{3})"),
    ("runner_joined", "([0-9]{4}[A-Z][0-9]{6})"),
    ("runner_old", "([A-Z]{2}[0-9][A-Z][0-9][A-Z]-[0-9]{3})"),
    ("cap", "([0-9]{8})"),
    ("outdoor", "([A-Z]{2}[0-9][A-Z]{2}[0-9]{2}[A-Z])"),
    ("dashed", "([A-Z]{1,3}[0-9]{3,5}-[0-9]{2,4})"),
    ("six_three", "([0-9]{6}-[0-9]{3})"),
    ("six_two", "([0-9]{6}-[0-9]{2})"),
    ("seven_colour", "([0-9]{7}-[A-Z]{2,5})"),
    ("outdoor_shoe", "(N[A-Z][0-9]{2}[A-Z][0-9]{2}[A-Z0-9])"),
    ("skate", "(VN[A-Z0-9]{9,10})"),
    ("canvas", "([0-9]{6}C)"),
    ("canvas_old", "(1J[0-9]{3}C)"),
    ("minimal", "(MT10[OT][A-Z0-9]{2,4})"),
    ("generic", "([A-Z]{1,2}[0-9]{3,5}[A-Z]{0,4}[0-9]{0,2})"),
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def either(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def normalize_model(c: Column) -> Column:
    """Upper case; white space and runs of dashes become one dash; none at the ends. Null becomes ''."""
    up = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(up, r"\s+", "-"), "-{2,}", "-"), "^-+|-+$", "")


def model_key(c: Column) -> Column:
    """Normalised without dashes: the join key."""
    return F.regexp_replace(normalize_model(c), r"[\s-]", "")


def models_match(a: Column, b: Column) -> Column:
    """Equal once normalised, or once stripped; an empty one never matches."""
    return (model_key(a) != "") & (model_key(b) != "") & ((normalize_model(a) == normalize_model(b)) | (model_key(a) == model_key(b)))


def model_candidates(text: Column) -> list[tuple[str, Column]]:
    """(pattern name, code or null) in order of precedence."""
    behind = F.regexp_extract(text, "/[ \t]*([A-Z0-9][-A-Z0-9]+)", 1)
    fits = F.when(either([F.nullif(behind, F.lit("")).rlike(p) for p in SLASH_PATTERNS[:2]]), behind)
    long = F.when(behind.rlike(SLASH_PATTERNS[2]) & F.substring(behind, 4, 20).rlike("[A-Z]"), behind)
    out = [("slash", F.coalesce(fits, long))]
    for name, pattern in MODEL_PATTERNS:
        code = blank_to_null(F.regexp_extract(text, _EDGE + pattern + _END, 1))
        if name == "runner_joined":
            code = F.when(code.isNotNull(), F.concat(F.substring(code, 1, 8), F.lit("-"), F.substring(code, 9, 3)))
        elif name == "cap":  # not a date
            code = F.when(~code.rlike("^(19|20)"), code)
        elif name == "generic":
            code = F.when(F.length(code) >= 5, code)
        out.append((name, code))
    return out


def extract_model(name: Column) -> Column:
    """The model number in a product name, normalised; null if there is none."""
    text = F.upper(F.trim(F.coalesce(name, F.lit(""))))
    return blank_to_null(normalize_model(F.coalesce(*[c for _, c in model_candidates(text)])))


def keywords(name: Column) -> Column:
    """Distinct lower-case words of a name."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[\s\-_/()]+"), lambda w: w != ""))


def is_collab(name: Column, words: tuple[str, ...] = COLLABS) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return either([low.contains(w) for w in words])


def collab_mismatch(market: Column, source: Column, words: tuple[str, ...] = COLLABS) -> Column:
    """The market's product is a collaboration and the source's is not; the other way round is fine."""
    return is_collab(market, words) & ~is_collab(source, words)


def subtypes(words: Column, known: tuple[str, ...] = SUBTYPES, synonyms: dict[str, str] | None = None) -> Column:
    """Edition words of a keyword array, synonyms folded."""
    same = SUBTYPE_SYNONYMS if synonyms is None else synonyms
    fold = lambda w: reduce(lambda a, kv: F.when(w == kv[0], F.lit(kv[1])).otherwise(a), same.items(), w)
    return F.array_distinct(F.transform(F.array_intersect(words, F.array(*[F.lit(k) for k in known])), fold))


def extra_subtypes(market_words: Column, source_words: Column, **kw) -> Column:
    """Edition words only the source has; any means another product."""
    return F.array_except(subtypes(source_words, **kw), subtypes(market_words, **kw))


def brand_slug(brand: Column, keep_other_letters: bool = False) -> Column:
    """Lower case; only a-z and 0-9, or only without spaces, dashes and underscores."""
    return F.regexp_replace(F.lower(F.coalesce(brand, F.lit(""))), r"[\s\-_]" if keep_other_letters else "[^a-z0-9]", "")


def style_colour(style: Column, colour: Column) -> Column:
    """Style with a three-digit colour appended; other colours are left out."""
    return F.when(colour.rlike("^[0-9]{3}$"), F.concat_ws("-", style, colour)).otherwise(style)


def underscore_model(c: Column) -> Column:
    """123456_01 or 123456-01 to 123456-01, else ''."""
    dashed = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "_", "-")
    return F.when(dashed.rlike("^[0-9]{6}-[0-9]{2}$"), dashed).otherwise("")


def style_digits(sku: Column) -> Column:
    """Five leading digits of a style code with an optional letter-digit tail, else null."""
    return blank_to_null(F.regexp_extract(F.upper(F.trim(sku)), "^([0-9]{5})([A-Z][0-9])?$", 1))


def style_number(sku: Column) -> Column:
    """Leading digits of a SKU as a number, so leading zeros drop."""
    return F.regexp_extract(sku, "([0-9]+)", 1).try_cast("bigint")


def sku_from_url(url: Column) -> Column:
    """Last path segment, upper case, dots as dashes."""
    return F.upper(F.regexp_replace(F.regexp_extract(url, r"/([^/?#]+)/?(?:[?#].*)?$", 1), r"\.", "-"))


def url_gender(url: Column) -> Column:
    """mens, womens, unisex or kids, where a path segment says so; else ''."""
    return F.lower(F.regexp_extract(url, "(?i)/(mens|womens|unisex|kids)(?:[/?#]|$)", 1))


def url_colour(url: Column) -> Column:
    """The colour in a last segment of the form colour-shoes-sku, in lower case; else ''."""
    return F.lower(F.regexp_extract(url, "(?i)/([a-z0-9-]+?)-shoes-[^/?#]+/?(?:[?#].*)?$", 1))


@F.pandas_udf(StringType())
def unescape_all(s: pd.Series) -> pd.Series:
    """All character references of HTML, named and numbered; a table no built-in function has."""
    return s.map(html.unescape, na_action="ignore")


def bracket_collab(name: Column) -> Column:
    """[A x B] in a name."""
    return F.coalesce(name.rlike(r"\[[^\[\]]*[xX×][^\[\]]*\]"), F.lit(False))


def search_phrase(name: Column, brands: tuple[str, ...], phrases: dict[str, str] | None = None) -> Column:
    """What to search a shop for: without parentheses and brand words; a known phrase's translation, else up to three
    words of Latin letters, else up to three words."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\([^)]*\)", " "), r"\s+", " "))
    for b in brands:
        bare = F.trim(F.regexp_replace(bare, rf"(?i)(?:^|\s){b}(?:$|\s)", " "))
    words = F.filter(F.split(bare, " "), lambda w: w != "")
    latin = F.filter(words, lambda w: w.rlike("^[A-Za-z0-9][A-Za-z0-9'.-]*$"))
    known = [F.when(bare.contains(k), F.lit(v)) for k, v in (phrases or {}).items()]
    return F.coalesce(*known, F.when(F.size(latin) > 0, F.array_join(F.slice(latin, 1, 3), " ")), F.array_join(F.slice(words, 1, 3), " "))


def first_pattern(c: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that is found; null if none is."""
    return F.coalesce(*[blank_to_null(F.regexp_extract(c, p, 1)) for p in patterns])


def thousands(c: Column) -> Column:
    return F.format_string("%,d", c)


def like_literal(c: Column) -> Column:
    """Escape what LIKE would read as a pattern."""
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def unescape_html(c: Column) -> Column:
    """The five predefined entities, the no-break space and the apostrophe's number; the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def colour_tokens(colour: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Words of a colour name; compounds are folded before single words."""
    low = F.lower(F.coalesce(colour, F.lit("")))
    for k, v in sorted((synonyms or {}).items(), key=lambda kv: -len(kv[0])):
        low = F.replace(low, F.lit(k), F.lit(v))
    return F.array_distinct(F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != ""))
