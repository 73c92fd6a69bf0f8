"""Values out of nested JSON and HTML: graphs with index references, deep searches, script tags, packed strings."""

from __future__ import annotations

import json
import math
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Wrappers that stand for their content.
WRAPPERS = ("Reactive", "ShallowReactive", "Ref", "ShallowRef", "EmptyRef", "EmptyShallowRef")
SPECIAL = {-1: None, -2: math.nan, -3: math.inf, -4: -math.inf}


def resolve(flat: list) -> object:
    """The object of a flattened graph: element 0 is the root, numbers inside lists and objects refer to elements,
    negative ones are special values. Shared elements are built once; cycles come back as null, as JSON has none. Paths
    of thousands of steps are resolved; one that Python's stack can't follow raises RecursionError."""
    done: dict[int, object] = {}
    open_: set[int] = set()
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(flat) + 1000))

    def at(i: object) -> object:
        if not isinstance(i, int) or isinstance(i, bool):
            return None
        if i < 0:
            return SPECIAL.get(i)
        if i >= len(flat) or i in open_:
            return None
        if i not in done:
            open_.add(i)
            done[i] = build(flat[i])
            open_.discard(i)
        return done[i]

    def build(v: object) -> object:
        if isinstance(v, dict):
            return {k: at(r) for k, r in v.items()}
        if not isinstance(v, list):
            return v
        tag, rest = (v[0], v[1:]) if v and isinstance(v[0], str) else ("", v)
        if tag in WRAPPERS:
            return at(rest[0]) if rest else None
        if tag == "Date":
            return rest[0] if rest else None
        if tag == "null":  # an object without prototype: names and references in turn
            return {k: at(r) for k, r in zip(rest[::2], rest[1::2])}
        if tag == "Map":
            pairs = ((at(k), at(r)) for k, r in zip(rest[::2], rest[1::2]))
            return {str(k): x for k, x in pairs if k is not None}
        return [at(r) for r in (rest if tag == "Set" else v)]

    return at(0)


def _clean(v: object) -> object:
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, dict):
        return {k: _clean(x) for k, x in v.items()}
    return [_clean(x) for x in v] if isinstance(v, list) else v


@F.pandas_udf(StringType())
def resolve_graph(flat: pd.Series) -> pd.Series:
    """JSON of the graph of a JSON array; null where it isn't one, or is nested too deeply for Python's stack (3,000 steps
    are not, 50,000 are). A recursion no built-in function has."""

    def one(s: str | None) -> str | None:
        try:
            v = json.loads(s) if s else None
            return json.dumps(_clean(resolve(v)), ensure_ascii=False) if isinstance(v, list) and v else None
        except (ValueError, RecursionError):
            return None

    return flat.map(one)


def find_values(node: object, key: str, depth: int = 10) -> list:
    """All values under a key, in document order, down to a depth."""
    if depth < 0:
        return []
    if isinstance(node, dict):
        return [x for k, v in node.items() for x in ([v] if k == key else []) + find_values(v, key, depth - 1)]
    return [x for v in node for x in find_values(v, key, depth - 1)] if isinstance(node, list) else []


def find_objects(node: object, keys: frozenset[str], depth: int = 10) -> list[dict]:
    """All objects that have the keys."""
    if depth < 0:
        return []
    if isinstance(node, dict):
        own = [node] if keys <= node.keys() else []
        return own + [x for v in node.values() for x in find_objects(v, keys, depth - 1)]
    return [x for v in node for x in find_objects(v, keys, depth - 1)] if isinstance(node, list) else []


def _json_list(find, c: Column) -> Column:
    @F.pandas_udf(ArrayType(StringType()))
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str]:
            try:
                return [json.dumps(v, ensure_ascii=False) for v in find(json.loads(x))] if x else []
            except (ValueError, RecursionError):
                return []

        return s.map(one)

    return run(c)


def deep_values(c: Column, key: str, depth: int = 10) -> Column:
    return _json_list(lambda v: find_values(v, key, depth), c)


def deep_objects(c: Column, keys: list[str], depth: int = 10) -> Column:
    want = frozenset(keys)
    return _json_list(lambda v: find_objects(v, want, depth), c)


def dig(c: Column, *path: str) -> Column:
    """A value by its path, null where a step is missing."""
    return F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path))


def first_key(c: Column, *names: str) -> Column:
    """The first alias that has a value."""
    return F.coalesce(*[F.nullif(F.get_json_object(c, f"$.{n}"), F.lit("")) for n in names])


def script_json(html: Column, marker: str) -> Column:
    """Content of the first script tag whose attributes hold the marker."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<script[^>]*{marker}[^>]*>(.*?)</script>", 1), F.lit(""))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"<title>([^<]*)</title>", 1)), F.lit(""))


def meta(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf'<meta[^>]+(?:name|property)="{name}"[^>]+content="([^"]*)"', 1), F.lit(""))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), 1)


def packed_options(c: Column) -> Column:
    """'240,168,10001/245,0,10001/' as an array of (size, stock, in_stock)."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), "/"), lambda x: x.rlike("^[^,]+,-?[0-9]+"))

    def option(x: Column) -> Column:
        stock = F.get(F.split(x, ","), F.lit(1)).try_cast("int")
        return F.struct(F.get(F.split(x, ","), F.lit(0)).alias("size"), stock.alias("stock"), (stock > 0).alias("in_stock"))

    return F.transform(parts, option)


def stocked_sizes(options: Column, size: str = "size", in_stock: str = "in_stock") -> Column:
    """Trimmed sizes in stock, blanks left out."""
    return F.filter(F.transform(F.filter(options, lambda o: o[in_stock]), lambda o: F.trim(o[size])), lambda s: s != "")


def option_stock(options: DataFrame, inventory: DataFrame, item: str, valid: str, stock: str) -> DataFrame:
    """Activated, valid options with their inventory; options without one are out of stock."""
    j = options.where(F.col(valid)).join(inventory, item, "left")
    return j.withColumn("in_stock", F.coalesce(F.col(stock) > 0, F.lit(False)))


def attribute_items(html: Column, attribute: str, schema: str) -> Column:
    """Objects that elements hold as JSON in an attribute (quotes written as entities), in page order, as an array."""
    from ..functions.text import unescape_html

    found = F.regexp_extract_all(html, F.lit(rf'{attribute}="([^"]*)"'), 1)
    return F.transform(found, lambda x: F.from_json(unescape_html(x), schema))


def unwrapped(doc: Column, names: tuple[str, ...], schema: str) -> Column:
    """The list that a JSON document is, or holds under the first of these names that it has."""
    inner = F.coalesce(*[F.get_json_object(doc, f"$.{n}") for n in names], F.lit("[]"))
    return F.from_json(F.when(F.ltrim(doc).startswith("["), doc).otherwise(inner), f"ARRAY<{schema}>")


def cards(docs: DataFrame, doc: str, keys: list[str], key: str, most: int = 20) -> DataFrame:
    """One row per item anywhere in a nested payload: objects that have the keys, the first of each `key`, the first
    `most` of a payload (a page's feature). Adds pos (from 1) and item (JSON)."""
    kept = [c for c in docs.columns if c != doc]
    found = docs.withColumn("_o", deep_objects(F.col(doc), keys))
    names = F.transform("_o", lambda o: F.get_json_object(o, f"$.{key}"))
    first = F.filter(F.col("_o"), lambda o, i: F.array_position(names, F.get_json_object(o, f"$.{key}")) == i + 1)
    return found.select(*kept, F.posexplode(F.slice(first, 1, most)).alias("pos", "item")).withColumn("pos", F.col("pos") + 1)


def item_by_id(doc: Column, keys: list[str], key: str, wanted: Column) -> Column:
    """The first object with the keys whose `key` is the wanted one, as JSON; null without one."""
    return F.get(F.filter(deep_objects(doc, keys), lambda o: F.get_json_object(o, f"$.{key}") == wanted), F.lit(0))


def colour_sizes(options: Column, colour: Column) -> Column:
    """Sizes of the second level below a colour that are on, can be ordered and are in stock. options: structs of level,
    parent, name, status, orderable, stock."""
    fit = F.filter(options, lambda o: (o["level"] == 2) & (o["parent"] == colour) & (o["status"] == "ON") & o["orderable"] & (o["stock"] > 0))
    return F.transform(fit, lambda o: o["name"])


def page_name(html: Column) -> Column:
    """A page's name by five ways, the first that gives one: the social title, the document's title, the main heading,
    the name in linked data, the first link's text."""
    tag = lambda p: F.nullif(F.trim(F.regexp_extract(html, p, 1)), F.lit(""))
    linked = F.nullif(F.trim(F.get_json_object(script_json(html, "ld\\+json"), "$.name")), F.lit(""))
    return F.coalesce(meta(html, "og:title"), title(html), tag(r"(?is)<h1[^>]*>([^<]*)</h1>"), linked, tag(r"<a [^>]*>([^<]*)</a>"))


def referenced(cache: Column, ref: Column) -> Column:
    """What a reference of a normalised cache ({"__ref": name}) stands for; other values stand for themselves."""
    name = F.get_json_object(ref, "$.__ref")
    return F.when(name.isNotNull(), F.get(F.map_values(F.map_filter(F.from_json(cache, "MAP<STRING, STRING>"), lambda k, _: k == name)), F.lit(0))).otherwise(ref)


def cached_sizes(cache: Column, product: str = "Product:", variants: str = "variants") -> Column:
    """Array of (sku, size, stock) out of a normalised cache: products name their variants by key; variants that are not
    there or lack a size or a stock are left out."""
    m = F.from_json(cache, "MAP<STRING, STRING>")
    products = F.filter(F.map_entries(m), lambda e: e["key"].startswith(product))

    def of(e: Column) -> Column:
        refs = F.coalesce(F.from_json(F.get_json_object(e["value"], f"$.{variants}"), "ARRAY<STRING>"), F.array().cast("array<string>"))
        value = lambda r, name: F.get_json_object(F.try_element_at(m, r), f"$.{name}")
        rows = F.transform(refs, lambda r: F.struct(F.get_json_object(e["value"], "$.sku").alias("sku"), value(r, "size").alias("size"), value(r, "stock").try_cast("bigint").alias("stock")))
        return F.filter(rows, lambda x: x["size"].isNotNull() & x["stock"].isNotNull())

    return F.flatten(F.transform(products, of))
