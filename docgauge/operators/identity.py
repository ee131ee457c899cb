"""Which site a URL belongs to, and whether a submitted URL can be scanned at all."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docgauge import constants as K
from docgauge.functions import urls as U
from docgauge.functions.let import bind
from docgauge.operators.common import first_per


def suffix_table(spark: SparkSession, public: Iterable[str], private: Iterable[str]) -> DataFrame:
    """The suffix dimension in the shape ``registrable`` expects, from rules as the public list writes them: ``co.uk``, ``*.ck``, ``!www.ck``."""
    rows = [(s, False) for s in public] + [(s, True) for s in private]
    return spark.createDataFrame(rows, "suffix string, private boolean")


def read_suffix_list(spark: SparkSession, path: str) -> DataFrame:
    """The public suffix list as a file: a rule a line, comments after ``//``, private rules between their two marks."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    opened, closed = F.col("line").contains("BEGIN PRIVATE DOMAINS"), F.col("line").contains("END PRIVATE DOMAINS")
    marks = lines.agg(F.min(F.when(opened, F.col("at"))).alias("first"), F.min(F.when(closed, F.col("at"))).alias("last"))
    first, last = marks.first()
    private = F.lit(False) if first is None else (F.col("at") > first) & (F.lit(last is None) | (F.col("at") < F.lit(last)))
    rule = F.regexp_extract(F.trim("line"), r"^([^\s/]\S*)", 1)
    return lines.filter(rule != "").select(F.lower(rule).alias("suffix"), private.alias("private"))


def normalize_submitted_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds https, lower-cases the host, drops its closing dot and tracking parameters.

    Adds ``submitted`` (null when it is not a URL) and ``hash_routed``; the fragment stays in ``submitted``.
    """
    typed = F.trim(F.col(url))
    with_scheme = F.when(typed.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), typed).otherwise(F.concat(F.lit("https://"), typed))
    df = U.with_url(df.withColumn("__typed", with_scheme), "__typed", "__s_")
    tracked = "|".join(K.TRACKING_PARAMS)
    pairs = F.filter(
        F.split(F.regexp_replace(F.col("__s_query"), r"^\?", ""), "&"),
        lambda pair: (pair != "") & ~F.lower(pair).rlike(rf"^(utm_[^=]*|{tracked})(=|$)"),
    )
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    origin = F.regexp_replace(F.col("__s_origin"), r"\.(:\d+)?$", "$1")
    return df.withColumns(
        {
            "submitted": F.when(F.col("__s_valid"), F.concat(origin, F.col("__s_path"), query, F.col("__s_fragment"))),
            "hash_routed": F.coalesce(F.col("__s_fragment").rlike("^#!?/"), F.lit(False)),
        }
    ).drop("__typed", *[f"__s_{c}" for c in ("valid", "origin", "host", "port", "path", "query", "fragment")])


def guess_scope(df: DataFrame, url: str = "submitted", prefix: str = "") -> DataFrame:
    """Scope of an entry URL: its own path and everything under it, with locale, version, key and profile."""
    df = U.with_url(df, url, "__g_")
    path = F.concat(F.lit("/"), F.array_join(U.segments(F.col("__g_path")), "/"))
    df = df.withColumn("__g_scope", F.when(F.col("__g_valid"), path))
    scope, host = F.col("__g_scope"), F.col("__g_host")
    bare_path = F.regexp_replace(scope, "/+$", "")
    port = F.when(F.col("__g_port") == "", "").otherwise(F.concat(F.lit(":"), F.col("__g_port")))
    return df.withColumns(
        {
            f"{prefix}scope_root": F.concat(F.col("__g_origin"), bare_path),
            f"{prefix}scope_key": F.concat(U.bare_host(host), port, bare_path),
            f"{prefix}origin": F.col("__g_origin"),
            f"{prefix}host": host,
            f"{prefix}path": scope,
            f"{prefix}locale": U.locale_in(scope),
            f"{prefix}version": U.version_in(scope),
            f"{prefix}hash_routed": F.col("__g_fragment").rlike("^#!?/"),
        }
    ).drop("__g_scope", *[f"__g_{c}" for c in ("valid", "origin", "host", "port", "path", "query", "fragment")])


def registrable(df: DataFrame, host: str, suffixes: DataFrame, prefix: str = "") -> DataFrame:
    """Adds ``base_domain`` (private suffixes allowed), ``subdomain_label`` and ``name_core`` of a host column.

    Distinct hosts are matched once, each exploded into the rules that could name its suffixes (plain, with a wildcard for the first label, an
    exception) and joined on equality; the longest match wins, and an exception above all, whose suffix is one label shorter. The result
    joins back on host, so a host holding most rows costs one dimension row.
    """
    hosts = df.select(F.col(host).alias("__host")).filter(F.col("__host").isNotNull()).distinct()
    labels = F.split(U.bare_host(F.col("__host")), r"\.")
    size = F.size("labels")
    exploded = (
        hosts.withColumn("labels", labels)
        .select("__host", "labels", F.explode(F.sequence(F.lit(1), size)).alias("n"))
        .withColumn("plain", F.array_join(F.slice("labels", size - F.col("n") + 1, F.col("n")), "."))
    )
    wild = F.concat(F.lit("*"), F.regexp_replace("plain", r"^[^.]*", ""))
    written = ((F.col("plain"), 0), (wild, 0), (F.concat(F.lit("!"), F.col("plain")), 1))
    rules = F.array(*[F.struct(suffix.alias("suffix"), F.lit(exception).alias("exception")) for suffix, exception in written])
    exploded = exploded.select("__host", "labels", "n", F.inline(rules)).filter((F.col("suffix") != "*") | (F.col("n") == 1))
    matched = exploded.join(suffixes, "suffix", "left")
    rank = F.struct("exception", (F.col("n") - F.col("exception")).alias("size"))
    best = matched.groupBy("__host").agg(
        F.first("labels").alias("labels"),
        F.max(F.when(F.col("private").isNotNull(), rank))["size"].alias("any_n"),
        F.max(F.when(~F.col("private"), rank))["size"].alias("public_n"),
    )
    # An unknown top-level label counts as a suffix of its own, as the public list's default rule says.
    any_n, public_n = F.coalesce("any_n", F.lit(1)), F.coalesce("public_n", F.lit(1))
    bare = U.bare_host(F.col("__host"))
    is_ip = bare.rlike(r"^[0-9.]+$|:")

    def domain(n: Column) -> Column:
        whole = F.array_join(F.slice("labels", size - n, n + 1), ".")
        return F.when(is_ip | (size <= n), bare).otherwise(whole)

    full_labels = F.split(F.col("__host"), r"\.")
    core_n = F.coalesce(F.col("any_n"), F.lit(1))
    dimension = best.select(
        "__host",
        domain(any_n).alias(f"{prefix}base_domain"),
        F.when(~is_ip & (F.size(full_labels) > public_n + 1), F.get(full_labels, F.lit(0))).alias(
            f"{prefix}subdomain_label"
        ),
        F.when(~is_ip & (size > core_n), F.get("labels", size - core_n - 1))
        .otherwise(F.get("labels", F.lit(0)))
        .alias(f"{prefix}name_core"),
    )
    return df.join(dimension, df[host] == dimension["__host"], "left").drop("__host")


def infer_profile(label: Column, path: Column) -> Column:
    first = F.lower(F.get(U.segments(path), F.lit(0)))
    is_help = F.coalesce(label.isin(*K.HELP_CENTER_HOST_LABELS), F.lit(False)) | F.coalesce(
        first.isin(*K.HELP_CENTER_SEGMENTS), F.lit(False)
    )
    return F.when(is_help, "help-center").otherwise("developer-docs")


def url_identity(df: DataFrame, url: str, suffixes: DataFrame) -> DataFrame:
    """The join keys of every URL-bearing table in one pass."""
    df = guess_scope(normalize_submitted_url(df, url).drop("hash_routed"), "submitted")
    df = registrable(df, "host", suffixes)
    return df.withColumns(
        {
            "page_key": U.page_key(F.col(url)),
            "profile": infer_profile(F.col("subdomain_label"), F.col("path")),
        }
    )


def landed_scope(df: DataFrame, submitted: str = "submitted", landed: str = "landed") -> DataFrame:
    """Keeps the submitted scope when the redirect stays inside it, else takes the landed one."""
    df = guess_scope(guess_scope(df, submitted, "__e_"), landed, "__l_")
    stays = (F.col("__l_origin") == F.col("__e_origin")) & U.is_within(F.col("__l_path"), F.col("__e_path"))
    names = ("scope_root", "scope_key", "host", "path", "version")
    chosen = {n: F.when(stays, F.col(f"__e_{n}")).otherwise(F.col(f"__l_{n}")) for n in names}
    # A root that redirects to /en-us/ tells which locale to sample.
    locale = F.when(stays, F.coalesce("__e_locale", "__l_locale")).otherwise(F.col("__l_locale"))
    return (
        df.withColumns({**chosen, "locale": locale, "hash_routed": F.col("__e_hash_routed"), "stays_in_scope": stays})
        .drop(*[f"__{s}_{n}" for s in "el" for n in (*names, "origin", "locale", "hash_routed")])
    )


# --- which URLs may be requested ---------------------------------------------------------------


def _ipv4_number(text: str) -> int:
    a, b, c, d = (int(p) for p in text.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def _ipv4_is_private(host: Column) -> Column:
    """Whether a dotted address falls in a non-public range; the fixed ranges become one expression."""

    def judged(octets: Column) -> Column:
        number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
        return F.exists(octets, lambda o: o.isNull() | (o > 255)) | bind(number, in_range)

    def in_range(number: Column) -> Column:
        inside = F.lit(False)
        for base, bits in K.NON_PUBLIC_IPV4:
            first = _ipv4_number(base)
            inside = inside | number.between(F.lit(first), F.lit(first + (1 << (32 - bits)) - 1))
        return inside

    return bind(F.transform(F.split(host, r"\."), lambda o: o.try_cast("bigint")), judged)


def _ipv6_words(address: Column) -> Column:
    """Eight 16-bit words of an IPv6 address as integers; another length when it does not parse."""

    def padded(halves: Column) -> Column:
        left = F.filter(F.split(F.get(halves, F.lit(0)), ":"), lambda w: w != "")
        right = F.filter(F.split(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), ":"), lambda w: w != "")
        gap = F.greatest(8 - F.size(left) - F.size(right), F.lit(0))
        return F.when(F.size(halves) == 2, F.concat(left, F.array_repeat(F.lit("0"), gap), right)).otherwise(left)

    return F.transform(bind(F.split(address, "::", -1), padded), lambda w: F.conv(w, 16, 10).cast("int"))


def _dotted_tail_as_words(address: Column) -> Column:
    """``::ffff:10.0.0.1`` as ``::ffff:a00:1``."""
    octets = F.transform(
        F.split(F.regexp_extract(address, r"(\d+\.\d+\.\d+\.\d+)$", 1), r"\."), lambda o: o.try_cast("int")
    )
    pair = lambda a, b: F.lower(F.hex(F.get(octets, F.lit(a)) * 256 + F.get(octets, F.lit(b))))
    return F.when(
        address.rlike(r"\d+\.\d+\.\d+\.\d+$"),
        F.concat(F.regexp_replace(address, r"\d+\.\d+\.\d+\.\d+$", ""), pair(0, 1), F.lit(":"), pair(2, 3)),
    ).otherwise(address)


def _ipv6_is_private(address: Column) -> Column:
    def judged(words: Column) -> Column:
        w = [F.get(words, F.lit(i)) for i in range(8)]
        mapped = F.forall(F.slice(words, 1, 5), lambda x: x == 0) & (w[5] == 0xFFFF)
        mapped_v4 = F.concat_ws(
            ".", F.shiftright(w[6], 8), F.pmod(w[6], F.lit(256)), F.shiftright(w[7], 8), F.pmod(w[7], F.lit(256))
        )
        special = (
            F.forall(F.slice(words, 1, 6), lambda x: x == 0)  # unspecified, loopback, retired IPv4-compatible form
            | w[0].between(0xFC00, 0xFDFF)  # unique local
            | w[0].between(0xFE80, 0xFEFF)  # link local and retired site local
            | w[0].between(0xFF00, 0xFFFF)  # multicast
            | (w[0] == 0x2002)  # 6to4
            | ((w[0] == 0x2001) & (w[1].isin(0, 2, 0xDB8) | w[1].between(0x10, 0x2F)))  # tunnels, tests, identifiers
            | ((w[0] == 0x64) & (w[1] == 0xFF9B))  # address translation
            | (F.forall(F.slice(words, 1, 4), lambda x: x == 0) & (w[4] == 0xFFFF) & (w[5] == 0))  # translated IPv4
            | (w[0] == 0x100)  # discard only
            | (w[0] == 0x3FFF)  # documentation
        )
        return F.when(F.size(words) != 8, True).when(mapped, _ipv4_is_private(mapped_v4)).otherwise(special)

    return bind(_ipv6_words(_dotted_tail_as_words(address)), judged)


def url_triage(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``refused``: why a submitted URL may not be requested, null when it may."""
    parts = F.col("__parts")
    bare = F.regexp_replace(F.regexp_replace(U.host_of(parts), r"^\[|\]$", ""), r"\.$", "")
    # Two projections: the host is needed by most rules and is computed once.
    df = df.withColumn("__parts", U.url_parts(F.col(url))).withColumn("__host", bare)
    scheme, host = F.lower(F.get(parts, F.lit(0))), F.col("__host")
    named = "|".join(s.replace(".", r"\.") for s in K.PRIVATE_HOST_SUFFIXES)
    refused = (
        F.when(~U.is_url(parts) & F.col(url).rlike(r"(?i)^\s*(?!https?:)[a-z][a-z0-9+.\-]*:"), "unsupported_scheme")
        .when(~U.is_url(parts), "invalid_url")
        .when(~scheme.isin("http", "https"), "unsupported_scheme")
        .when(host == "", "invalid_url")
        .when(F.get(parts, F.lit(1)) != "", "credentials_in_url")
        .when(~U.port_of(parts).isin(*K.ALLOWED_PORTS), "blocked_port")
        .when(host.rlike(r"^\d+(\.\d+){3}$"), F.when(_ipv4_is_private(host), "private_address"))
        .when(F.contains(host, F.lit(":")), F.when(_ipv6_is_private(host), "private_address"))
        .when(~F.contains(host, F.lit(".")) | host.rlike(rf"(^|\.)({named})$"), "private_address")
    )
    return df.withColumn("refused", refused).drop("__parts", "__host")


# --- what the entry response says ---------------------------------------------------------------


def target_outcome(df: DataFrame) -> DataFrame:
    """Adds ``outcome`` and ``outcome_reason`` to entry responses (``url, status, content_type, failure``)."""
    parts = U.url_parts(F.col("url"))
    host = U.host_of(parts)
    status, failure = F.col("status"), F.col("failure")
    kind = F.coalesce("content_type", F.lit(""))
    outcome = (
        F.when(failure.isNotNull(), failure)
        .when(status.isin(404, 410), "not_found")
        .when(status >= 500, "server_error")
        .when((status < 400) & (kind != "") & ~kind.rlike("(?i)html|markdown|text/plain"), "not_html")
        .otherwise("scannable")
    )
    wording = {
        "blocked": F.concat(host, F.lit(" is not a public website, so it cannot be scanned.")),
        "robots": F.concat(host, F.lit(" asks crawlers not to read this page in its robots.txt, so we did not scan it.")),
        "robots_unreachable": F.concat(
            host, F.lit(" did not let us read its robots.txt just now, so we did not scan it. Try again in a moment.")
        ),
        "dns": F.concat(F.lit("We could not find "), host, F.lit(". Check the spelling of the address.")),
        "timeout": F.concat(host, F.lit(" took too long to answer. Try again in a moment.")),
        "tls": F.concat(host, F.lit(" has a certificate problem, so we could not connect securely.")),
        "connection": F.concat(host, F.lit(" refused the connection.")),
        "redirects": F.concat(F.col("url"), F.lit(" redirects too many times.")),
        "not_found": F.concat(
            F.col("url"), F.lit(" returned "), status.cast("string"), F.lit(". Check the address and try again.")
        ),
        "server_error": F.concat(
            host, F.lit(" answered with a server error ("), status.cast("string"), F.lit("). Try again later.")
        ),
        "not_html": F.concat(F.col("url"), F.lit(" is not a web page ("), F.split(kind, ";")[0], F.lit(").")),
    }
    reason = F.when(F.col("outcome") == "scannable", None)
    for code, text in wording.items():
        reason = reason.when(F.col("outcome") == code, text)
    reason = reason.otherwise(F.concat(F.lit("We could not load "), F.col("url"), F.lit(".")))
    return df.withColumn("outcome", outcome).withColumn("outcome_reason", reason)


def unreadable_reason(status: Column, failure: Column) -> Column:
    """Wording of why a page could not be read."""
    return (
        F.when(failure.isNull(), F.concat(F.lit("it answered "), status.cast("string")))
        .when(failure == "robots", "robots.txt does not allow it")
        .when(failure == "robots_unreachable", "its robots.txt could not be read")
        .when(failure.isin("deadline", "budget"), "the scan reached its time or request limit first")
        .when(failure == "timeout", "it took too long to answer")
        .otherwise("the request failed")
    )


def docs_elsewhere(sites: DataFrame, responses: DataFrame, suffixes: DataFrame) -> DataFrame:
    """For bare domains, the first of ``docs.<domain>`` and ``/docs`` that answers as a page other than the home page.

    ``sites``: ``site_key, submitted, scope_root``; ``responses``: ``url, status, content_type, final_url``.
    Returns ``site_key, docs_elsewhere`` for the sites that have one.
    """
    bare = U.with_url(U.with_url(sites.select("site_key", "submitted", "scope_root"), "submitted", "s_"), "scope_root", "r_")
    bare = registrable(bare.filter((F.col("s_path") == "/") & (F.col("r_path") == "/")), "r_host", suffixes)
    bare = bare.filter(~F.coalesce(F.col("subdomain_label").isin(*K.DOCS_HOST_LABELS), F.lit(False)))
    candidates = bare.select(
        "site_key", "r_origin", "base_domain",
        F.posexplode(
            F.array(
                F.concat(F.lit("https://docs."), F.col("base_domain"), F.lit("/")),
                F.concat(F.col("r_origin"), F.lit("/docs")),
            )
        ).alias("candidate_ord", "candidate"),
    )
    pages = responses.filter((F.col("status") == 200) & F.col("content_type").rlike("(?i)html|markdown"))
    hits = candidates.join(pages.select(F.col("url").alias("candidate"), "final_url"), "candidate")
    hits = U.with_url(U.with_url(hits, "final_url", "l_"), "candidate", "c_")
    hits = registrable(hits, "l_host", suffixes, "l_")
    home = (F.col("l_origin") == F.col("r_origin")) & (F.regexp_replace("l_path", "/+$", "") == "")
    hits = hits.filter(~home & (F.col("l_base_domain") == F.col("base_domain")))
    # The candidate itself when it answers on its own host, else the docs section it landed on.
    own = F.concat(U.bare_host(F.col("c_host")), F.regexp_replace("c_path", "/+$", ""))
    section = F.get(U.segments(F.col("l_path")), F.lit(0))
    landed = F.concat(
        U.bare_host(F.col("l_host")),
        F.when(F.col("l_port") == "", "").otherwise(F.concat(F.lit(":"), F.col("l_port"))),
        F.coalesce(F.concat(F.lit("/"), section), F.lit("")),
    )
    hits = hits.withColumn("docs_elsewhere", F.when(F.col("l_origin") == F.col("c_origin"), own).otherwise(landed))
    return first_per(hits, ["site_key"], ["candidate_ord"]).select("site_key", "docs_elsewhere")


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """sha256 of the key-sorted JSON of the given columns, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)
