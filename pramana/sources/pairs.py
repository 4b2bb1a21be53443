"""Pages that exist in two languages: from titles to document pairs, and to texts worth keeping."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: shorter texts are no documents.
LEAST_CHARS = 500


def get_json(url: str, params: dict[str, str], *, attempts: int = 4, open_url: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The JSON object at an address. Busy servers, broken connections and bodies that are no JSON are tried again after 0.75 s, 1.5 s and so on."""
    address = f"{url}?{urllib.parse.urlencode(params)}"
    for n in range(attempts):
        try:
            with open_url(address, timeout=30) as answer:
                return json.loads(answer.read().decode("utf-8"))
        except (urllib.error.URLError, ValueError, OSError) as e:
            if n + 1 == attempts:
                raise ConnectionError(f"{url}: {e}") from None
            sleep(0.75 * 2**n)
    raise AssertionError


def resolve_pairs(schemes: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, missing, unpaired) of ``schemes`` (scheme, en_title, category) among ``pages`` (asked, title, other_title).

    pages: what an index says of each asked title: the title it leads to (null if there is none) and that in the other language (null
    if there is none). resolved: ``scheme, category, title, other_title``; missing and unpaired: ``scheme, en_title``.
    """
    found = schemes.join(pages.withColumnRenamed("asked", "en_title"), "en_title", "left")
    resolved = found.where("title is not null and other_title is not null").select("scheme", "category", "title", "other_title")
    return resolved, found.where("title is null").select("scheme", "en_title"), found.where("title is not null and other_title is null").select("scheme", "en_title")


def keep_pairs(documents: DataFrame, *, least: int = LEAST_CHARS) -> DataFrame:
    """Of ``documents`` (scheme, lang, text, ...) those of at least ``least`` characters whose scheme has one in English and in Hindi, with the SHA-256 of the text."""
    long = documents.where((F.length("text") >= least) & F.col("lang").isin("en", "hi"))
    both = long.groupBy("scheme").agg(F.countDistinct("lang").alias("langs")).where("langs = 2").select("scheme")
    return long.join(both, "scheme", "left_semi").withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256))
