"""Links in llms.txt files (``site_key, url, content``)."""

from pyspark.sql import Column, DataFrame, functions as F

from docgauge.operators.common import numbered


def llms_links(llms_txt: DataFrame) -> DataFrame:
    """``site_key, link_ord, link`` of Markdown links."""
    found = F.regexp_extract_all("content", F.lit(r"\((https?://[^)\s]+)\)"), F.lit(1))
    return numbered(llms_txt, ["site_key"], found, "link_ord", "link")


def advertised_mcp_urls(llms_txt: Column) -> Column:
    """Endpoints named in llms.txt: an ``mcp.`` host, or a path ending in ``/mcp`` or ``/_mcp``; the first two."""
    found = F.regexp_extract_all(llms_txt, F.lit(r"""(https?://[^\s)<>"'`]+)"""), F.lit(1))
    named = F.filter(
        found,
        lambda url: url.rlike(r"(?i)^https?://([^/?#@]*@)?mcp\.") | url.rlike(r"^https?://[^/?#]+[^?#]*/_?mcp/?([?#]|$)"),
    )
    return F.slice(named, 1, 2)
