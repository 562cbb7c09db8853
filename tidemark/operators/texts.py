"""Text operators as column expressions: cleaning, masking, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def collapsed(text: Column | str) -> Column:
    """White space runs become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint(text: Column | str) -> Column:
    """A digest that white space and case don't change."""
    return F.sha2(F.lower(collapsed(text)), 256)


def approximate_tokens(text: Column | str) -> Column:
    """Four tokens for three words, at least one."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.floor(words * 4 / 3), F.lit(1)).cast("long")


def masked(text: Column | str) -> Column:
    """E-mail addresses and IPv4 addresses replaced by their kind."""
    mailless = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    return F.regexp_replace(mailless, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[IP]")


def main_text(html: Column | str) -> Column:
    """Text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return collapsed(F.regexp_replace(bare, "<[^>]*>", " "))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link) of the different links of each page."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return pages.select("page_id", F.explode(found).alias("link"))


def slug(text: Column | str) -> Column:
    """Letters and digits of any script stay in lower case, punctuation goes, and runs of white space and hyphens become one hyphen."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"^\s+|\s+$", ""), r"[\s-]+", "-")


def sentences(text: Column | str) -> Column:
    return F.filter(F.split(text, r"[.!?]\s+"), lambda s: s != "")


def last_entity(turns: DataFrame) -> DataFrame:
    """The name that was last used before each turn of its conversation."""
    name = F.nullif(F.regexp_extract("text", "(?:^| )([A-Z][a-z]{3,})", 1), F.lit(""))
    before = W.Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.Window.unboundedPreceding, -1)
    return turns.withColumn("name", name).select("conv_id", "turn", "role", "name", F.last("name", ignorenulls=True).over(before).alias("antecedent"))
