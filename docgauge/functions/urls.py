"""URL identity as column expressions: what a link means, and whether two links name one document.

One regular expression splits a URL; the rest are string expressions, so everything stays inside the scan's
projection. Hosts are lower-cased and non-ASCII path characters percent-encoded, as browsers do.
"""

from pyspark.sql import Column, DataFrame, functions as F

from docgauge import constants as K
from docgauge.functions.let import bind

_MARK = "\x01"
_SPLIT = (
    r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:\[\]]*)(?::([0-9]*))?"
    r"((?:/[^?#]*)?)((?:\?[^#]*)?)((?:#.*)?)$"
)
_UNSAFE = r"""[^\x21-\x7e]|["<>`{}^]"""


def url_parts(url: Column) -> Column:
    """``[scheme, userinfo, host, port, path, query, fragment]``; an array of one element when it is not a URL."""
    clean = F.regexp_replace(F.trim(url), r"[\t\r\n]", "")
    return F.split(F.regexp_replace(clean, _SPLIT, _MARK.join(f"${i}" for i in range(1, 8))), _MARK, -1)


def is_url(parts: Column) -> Column:
    return F.size(parts) == 7


def is_web(parts: Column) -> Column:
    return is_url(parts) & F.lower(F.get(parts, F.lit(0))).isin("http", "https") & (F.get(parts, F.lit(2)) != "")


def encode_path(path: Column) -> Column:
    encoded = F.array_join(
        F.transform(
            F.split(path, ""),
            lambda ch: F.when(ch.rlike(_UNSAFE), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch),
        ),
        "",
    )
    return F.when(path.rlike(_UNSAFE), encoded).otherwise(path)


def remove_dots(path: Column) -> Column:
    """Resolves ``.`` and ``..`` segments."""
    kept = F.aggregate(
        F.split(path, "/", -1),
        F.array().cast("array<string>"),
        lambda done, seg: F.when(seg == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .when(seg == ".", done)
        .otherwise(F.concat(done, F.array(seg))),
    )
    closing = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), closing)).otherwise(path)


def host_of(parts: Column) -> Column:
    return F.lower(F.get(parts, F.lit(2)))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def port_of(parts: Column) -> Column:
    """The explicit port, empty when it is the scheme's own."""
    scheme, port = F.lower(F.get(parts, F.lit(0))), F.get(parts, F.lit(3))
    default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
    return F.when(default, "").otherwise(port)


def path_of(parts: Column) -> Column:
    path = F.get(parts, F.lit(4))
    return F.when(path == "", "/").otherwise(encode_path(remove_dots(path)))


def origin_of(parts: Column) -> Column:
    port = port_of(parts)
    return F.concat(
        F.lower(F.get(parts, F.lit(0))), F.lit("://"), host_of(parts),
        F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)),
    )


def query_of(parts: Column) -> Column:
    return F.replace(F.get(parts, F.lit(5)), F.lit(" "), F.lit("%20"))


def with_url(df: DataFrame, url: str, prefix: str = "u_") -> DataFrame:
    """The identity columns of one URL column, in two projections (split once, then derive)."""
    parts = F.col("__parts")
    return (
        df.withColumn("__parts", url_parts(F.col(url)))
        .withColumns(
            {
                f"{prefix}valid": is_web(parts),
                f"{prefix}origin": F.when(is_web(parts), origin_of(parts)),
                f"{prefix}host": F.when(is_web(parts), host_of(parts)),
                f"{prefix}port": F.when(is_web(parts), port_of(parts)),
                f"{prefix}path": F.when(is_web(parts), path_of(parts)),
                f"{prefix}query": F.when(is_web(parts), query_of(parts)),
                f"{prefix}fragment": F.when(is_web(parts), F.get(parts, F.lit(6))),
            }
        )
        .drop("__parts")
    )


def page_key(url: Column) -> Column:
    """One document however it was linked: no scheme, ``www.``, port, Markdown suffix, closing slash, query or fragment."""

    def key(parts):
        path = path_of(parts)
        for ending in (r"/index\.mdx?$", r"\.mdx?$", r"/+$"):
            path = F.regexp_replace(path, ending, "")
        return F.when(is_url(parts), F.concat(bare_host(host_of(parts)), path)).otherwise(url)

    return bind(url_parts(url), key)


def same_page(left: Column, right: Column) -> Column:
    return page_key(left) == page_key(right)


def short_path(url: Column) -> Column:
    def short(parts):
        path = path_of(parts)
        return F.when(~is_url(parts), url).when(path == "/", host_of(parts)).otherwise(path)

    return bind(url_parts(url), short)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda seg: seg != "")


def locale_in(path: Column) -> Column:
    first = F.filter(F.slice(segments(path), 1, 3), lambda seg: seg.rlike(K.LOCALE_SEGMENT))
    return F.lower(F.get(first, F.lit(0)))


def version_in(path: Column) -> Column:
    return F.get(F.filter(segments(path), lambda seg: seg.rlike(K.VERSION_SEGMENT)), F.lit(0))


def is_within(path: Column, root: Column) -> Column:
    """Whole-segment containment: ``/docs`` holds ``/docs/x`` but not ``/docs-old``."""
    base = F.regexp_replace(root, "/+$", "")
    return (base == "") | (path == base) | F.startswith(path, F.concat(base, F.lit("/")))


def in_scope(host: Column, path: Column, root_host: Column, root_path: Column, pages_only: bool = True) -> Column:
    inside = (bare_host(host) == bare_host(root_host)) & is_within(path, root_path)
    return inside & ~path.rlike(K.ASSET_EXTENSIONS) if pages_only else inside


def strip_slashes(url: Column) -> Column:
    stripped = F.regexp_replace(url, "/+$", "")
    return F.when(stripped == "", url).otherwise(stripped)


def unique_urls(urls: Column) -> Column:
    return F.array_distinct(F.transform(urls, strip_slashes))


def resolve_href(base: Column, href: Column) -> Column:
    """An ``href`` against the page it is on: ``struct(url, fragment)``, null when it is not a web link."""

    def resolved(base_parts):
        base_origin, base_path = origin_of(base_parts), path_of(base_parts)
        folder = F.regexp_replace(base_path, "[^/]*$", "")
        here = F.concat(base_origin, base_path)
        absolute = (
            F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), href)
            .when(F.startswith(href, F.lit("//")), F.concat(F.lower(F.get(base_parts, F.lit(0))), F.lit(":"), href))
            .when(F.startswith(href, F.lit("/")), F.concat(base_origin, href))
            .when(F.startswith(href, F.lit("?")), F.concat(here, href))
            .when(F.startswith(href, F.lit("#")), F.concat(here, query_of(base_parts), href))
            .otherwise(F.concat(base_origin, folder, href))
        )
        return bind(url_parts(absolute), finish)

    def finish(parts):
        address = F.concat(origin_of(parts), path_of(parts), query_of(parts))
        raw = F.regexp_replace(F.get(parts, F.lit(6)), "^#", "")
        decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
        return F.when(
            is_web(parts), F.struct(address.alias("url"), F.nullif(decoded, F.lit("")).alias("fragment"))
        )

    return bind(url_parts(base), resolved)
