"""Facts from page HTML with built-in string functions, so page parsing never leaves the JVM.

``content_html`` finds the article element by balancing its own tag: the page after the opening tag is split on
that tag, a fold over the tokens finds where the depth returns to zero, and the text up to there is the element.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from docgauge.functions.let import bind
from docgauge.functions.text import collapse

_COMMON_NOISE, _RARE_NOISE = ("script", "style"), ("noscript", "template", "svg")
_ATTR = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""

# Content roots in order of preference: (pattern of the opening tag, tag name or None to read it from the match).
_MAIN_ARTICLE = r"(?is)<main\b[^>]*>.*?(<article\b[^>]*>)"
_ROOTS = (
    r"(?i)<(article)\b[^>]*>",
    r"(?i)<(main)\b[^>]*>",
    r"""(?i)<([a-z][a-z0-9]*)\b[^>]*\brole\s*=\s*["']?main["']?[^>]*>""",
    r"""(?i)<([a-z][a-z0-9]*)\b[^>]*\bid\s*=\s*["']?content["'\s>][^>]*>?""",
    r"""(?i)<([a-z][a-z0-9]*)\b[^>]*\bclass\s*=\s*(?:"(?:[^"]*\s)?content(?:\s[^"]*)?"|'(?:[^']*\s)?content(?:\s[^']*)?')[^>]*>""",
    r"(?i)<(body)\b[^>]*>",
)

_NAMED_ENTITIES = (
    ("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"),
    ("&reg;", "®"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&middot;", "·"), ("&bull;", "•"), ("&rarr;", "→"), ("&larr;", "←"),
    ("&amp;", "&"),
)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def without_noise(html: Column) -> Column:
    """The page without comments and elements that are no text. Patterns run only where a plain search finds how they begin."""

    def removed(text: Column, tags: tuple[str, ...]) -> Column:
        for tag in tags:
            text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
        return text

    def begins(text: Column) -> Column:
        return bind(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(f"<{tag}")) for tag in _RARE_NOISE]))

    commented = F.when(F.contains(html, F.lit("<!--")), F.regexp_replace(html, r"(?s)<!--.*?-->", "")).otherwise(html)
    return bind(
        removed(commented, _COMMON_NOISE), lambda text: F.when(begins(text), removed(text, _RARE_NOISE)).otherwise(text)
    )


def json_ld(html: Column) -> Column:
    block = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""
    return _all(html, block, 1)


def content_html(clean: Column) -> Column:
    """Inner HTML of the preferred content element of a page whose noise is already removed."""

    def opened(pattern: str) -> Column:
        return F.regexp_substr(clean, F.lit(pattern))

    # `main article` wins when an article opens inside a main, before the main closes; the match ends with the article's tag.
    inside = ~F.contains(F.lower(F.regexp_substr(clean, F.lit(_MAIN_ARTICLE))), F.lit("</main"))
    nested = F.when(inside, F.regexp_extract(clean, _MAIN_ARTICLE, 1)).otherwise("")
    nested_at = F.length(F.regexp_substr(clean, F.lit(_MAIN_ARTICLE)))
    candidates = [
        F.when(
            nested != "",
            F.struct(
                F.lit("article").alias("tag"),
                (F.locate("<main", F.lower(clean)) + nested_at).alias("after"),
            ),
        )
    ]
    for pattern in _ROOTS:
        tag_open = opened(pattern)
        candidates.append(
            F.when(
                tag_open.isNotNull(),
                F.struct(
                    F.lower(F.regexp_extract(tag_open, r"^<([A-Za-z][A-Za-z0-9]*)", 1)).alias("tag"),
                    (F.instr(clean, tag_open) + F.length(tag_open)).alias("after"),
                ),
            )
        )
    return bind(
        F.coalesce(*candidates),
        lambda root: F.when(root.isNull(), clean).otherwise(
            bind(F.substr(clean, root["after"]), lambda rest: _balanced(rest, root["tag"]))
        ),
    )


def _balanced(rest: Column, tag: Column) -> Column:
    """The text before the end tag that closes an element already opened."""
    token = F.concat(F.lit("(?i)</?"), tag, F.lit(r"(?=[\s>/])[^>]*>"))
    tokens = F.regexp_extract_all(rest, token, F.lit(0))
    # Mostly no element of this name lies inside: then the first token ends it.
    return bind(
        F.regexp_substr(rest, token),
        lambda first: F.when(F.startswith(first, F.lit("</")), F.left(rest, F.instr(rest, first) - 1)).otherwise(
            bind(F.split(rest, token, -1), lambda pieces: _cut_at_end(rest, tokens, pieces))
        ),
    )


def _cut_at_end(rest: Column, tokens: Column, pieces: Column) -> Column:
    start = F.struct(
        F.lit(1).alias("depth"), F.lit(0).cast("bigint").alias("end"), F.lit(0).alias("i"), F.lit(False).alias("done")
    )

    def step(state, tok):
        depth = state["depth"] + F.when(F.startswith(tok, F.lit("</")), -1).otherwise(1)
        upto = state["end"] + F.length(F.get(pieces, state["i"]))
        closed = depth == 0
        moved = F.struct(
            depth.alias("depth"),
            F.when(closed, upto).otherwise(upto + F.length(tok)).cast("bigint").alias("end"),
            (state["i"] + 1).alias("i"),
            closed.alias("done"),
        )
        return F.when(state["done"], state).otherwise(moved)

    def cut(state):
        return F.when(state["done"], F.left(rest, state["end"])).otherwise(rest)

    return F.aggregate(tokens, start, step, cut)


def decode_entities(text: Column) -> Column:
    return bind(text, lambda t: F.when(F.contains(t, F.lit("&")), _decoded(t)).otherwise(t))


def _decoded(text: Column) -> Column:
    numeric = F.array_distinct(_all(text, r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"))

    def char_of(entity: Column) -> Column:
        code = F.when(
            entity.rlike("^&#[xX]"), F.conv(F.regexp_extract(entity, "([0-9a-fA-F]+);$", 1), 16, 10).cast("int")
        ).otherwise(F.regexp_extract(entity, "([0-9]+);$", 1).cast("int"))
        return F.when(
            code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF),
            F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"),
        ).otherwise("�")

    decoded = F.when(
        F.contains(text, F.lit("&#")),
        F.aggregate(numeric, text, lambda acc, entity: F.replace(acc, entity, char_of(entity))),
    ).otherwise(text)
    return F.aggregate(_entity_table(), decoded, lambda acc, pair: F.replace(acc, pair["entity"], pair["char"]))


def _entity_table() -> Column:
    pairs = ", ".join(
        f"struct('{name}' AS entity, '{chr(92) + char if char in (chr(39), chr(92)) else char}' AS char)"
        for name, char in _NAMED_ENTITIES
    )
    return F.expr(f"array({pairs})")


def text_of(fragment: Column) -> Column:
    return collapse(decode_entities(F.regexp_replace(fragment, r"(?s)<[/!a-zA-Z][^>]*>", "")))


def attribute(tag: Column, name: str) -> Column:
    """The value of one attribute in an opening tag; null when it is absent."""
    pattern = rf"(?is)[\s\"'/]{name}{_ATTR}"

    def value(tag: Column) -> Column:
        quoted = F.concat(*[F.regexp_extract(tag, pattern, group) for group in (1, 2, 3)])
        return F.when(tag.rlike(pattern), decode_entities(quoted))

    return bind(tag, value)


def anchor_ids(clean: Column) -> Column:
    """Every ``id`` and every ``<a name>`` on a page: what a ``#fragment`` can land on."""
    with_id = F.transform(_all(clean, rf"(?is)<[a-z][^>]*?\sid{_ATTR}[^>]*>"), lambda tag: attribute(tag, "id"))
    named = F.transform(_all(clean, rf"(?is)<a\b[^>]*?\sname{_ATTR}[^>]*>"), lambda tag: attribute(tag, "name"))
    return F.filter(F.array_distinct(F.transform(F.concat(with_id, named), lambda v: F.trim(v))), lambda v: v != "")


def hrefs(fragment: Column) -> Column:
    """``href`` values of links in order, without mail, phone, script and data links."""
    tags = _all(fragment, rf"(?is)<a\b[^>]*?\shref{_ATTR}[^>]*>")
    values = F.transform(tags, lambda tag: F.trim(attribute(tag, "href")))
    return F.filter(values, lambda v: (v != "") & ~v.rlike("(?i)^(mailto|tel|javascript|data):"))


def meta_values(clean: Column) -> Column:
    """The ``<meta>`` tags of a page as ``array<struct<key, content>>``, keys as ``name:generator``; read in one scan."""
    tags = _all(clean, r"(?i)<meta\b[^>]*>")
    key = r"""(?is)\s(name|property|itemprop)\s*=\s*["']?([^"'\s/>]+)"""
    return F.transform(
        tags,
        lambda tag: F.struct(
            F.concat_ws(":", F.lower(F.regexp_extract(tag, key, 1)), F.regexp_extract(tag, key, 2)).alias("key"),
            attribute(tag, "content").alias("content"),
        ),
    )


def meta_value(metas: Column, key: str, value: str) -> Column:
    """``content`` of the first ``<meta key="value">``."""
    return F.get(F.filter(metas, lambda m: m["key"] == f"{key}:{value}"), F.lit(0))["content"]


def has_meta(metas: Column, name: str) -> Column:
    return F.exists(metas, lambda m: m["key"] == f"name:{name}")


def title_of(clean: Column) -> Column:
    raw = F.regexp_extract(clean, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return F.nullif(F.trim(decode_entities(raw)), F.lit(""))


def selector_rlike(selector: str) -> str:
    """The pattern of an opening tag that a simple ``#id``, ``.class`` or ``tag.class`` selector matches."""
    if selector.startswith("#"):
        return rf"""(?s)<[a-zA-Z][^>]*?\s(?i:id)\s*=\s*["']?{selector[1:]}["'\s/>]"""
    tag, _, cls = selector.partition(".")
    tag = f"(?i:{tag})" if tag else "[a-zA-Z][a-zA-Z0-9-]*"
    return rf"""(?s)<{tag}(?=\s)[^>]*?\s(?i:class)\s*=\s*(?:"(?:[^"]*\s)?{cls}(?:\s[^"]*)?"|'(?:[^']*\s)?{cls}(?:\s[^']*)?'|{cls}[\s>])"""


def time_values(fragment: Column) -> Column:
    tags = _all(fragment, rf"(?is)<time\b[^>]*?\sdatetime{_ATTR}[^>]*>")
    return F.transform(tags, lambda tag: attribute(tag, "datetime"))
