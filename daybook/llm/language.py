"""Language of a text by compression: the language whose dictionary makes the text smallest.

Each language gets a zstandard raw-content dictionary, a bounded number of passages of labelled texts. A whole text is
compressed once with each dictionary, in blocks, so that a long text does not become its own dictionary; the smallest
total wins, and a narrow lead over the second rejects the text. Case is folded on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def learn_dictionaries(labelled: DataFrame, passages: int = 96, passage_chars: int = 1500) -> dict[str, bytes]:
    """``passages`` passages of ``passage_chars`` characters of each language of ``labelled`` (text, lang), or as many as
    the language has different texts.

    This is the bound of what reaches the driver and, as a broadcast, the executors (about 150 KB a language). Texts are
    drawn by hash, so equal texts count once; rows without text or language teach nothing.
    """
    known = labelled.where("lang is not null and text is not null and text != ''").select("text", "lang", F.xxhash64("text").alias("h"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - passage_chars, F.lit(0)) + 1).cast("int") + 1
    # Twice the share wanted, so that the draw seldom falls short; the surplus is cut below. What did fall short is drawn anew.
    drawn: dict[str, list[str]] = {}
    missing, times = dict(counts), 2
    while missing:
        share = F.element_at(F.create_map(*[x for k, n in missing.items() for x in (F.lit(k), F.lit(min(1.0, times * passages / n)))]), F.col("lang"))
        rows = known.where(F.pmod("h", F.lit(1 << 30)) < share * float(1 << 30)).select(
            "lang", "h", F.substr("text", start, F.lit(passage_chars)).alias("passage")).distinct().collect()
        for lang in missing:
            drawn[lang] = [p for _, p in sorted((r.h, r.passage) for r in rows if r.lang == lang)[:passages]]
        missing = {k: n for k, n in missing.items() if len(drawn[k]) < min(passages, n) and times * passages < n}
        times *= 2
    out: dict[str, bytes] = {}
    for lang in sorted(counts):
        out[lang] = "\n".join(drawn[lang]).lower().encode()
    return {k: v for k, v in out.items() if v}


def predict(text: Column, dictionaries: dict[str, bytes], level: int = 6, block: int = 4000) -> Column:
    """struct<lang, score>: the winner and its lead, 1 - smallest / second smallest size (1 if one language is known).

    ``und`` and 0 where the text is null or has no letter, or nothing was learned. Ties go to the first name.
    """
    names, contents = list(dictionaries), list(dictionaries.values())

    @F.pandas_udf("lang string, score double")
    def smallest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = []
        for content in contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        for batch in batches:
            rows = []
            for t in batch:
                if t is None or not coders or not LETTER.search(t):
                    rows.append((UNKNOWN, 0.0))
                    continue
                raw = t.lower().encode()
                blocks = [raw[i : i + block] for i in range(0, len(raw), block)]
                sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((s for i, s in enumerate(sizes) if i != best), default=None)
                rows.append((names[best], 1.0 if second is None else 1 - sizes[best] / second))
            yield pd.DataFrame(rows, columns=["lang", "score"])

    return smallest(text)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_lead: float = 0.002) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` (no language, or a lead below ``min_lead``) added.

    Every text is compressed whole. Rows are judged one by one: repeated rows and null ids change nothing, no rows give no rows.
    Existing columns of those three names are replaced.
    """
    clash = {"lang_pred", "score", "rejected", "_guess"}
    own = [F.col(f"`{c}`") for c in docs.columns if c not in clash]
    guessed = docs.select(*own, predict(F.col("text"), dictionaries).alias("_guess"))
    return guessed.select(*own, F.col("_guess.lang").alias("lang_pred"), F.col("_guess.score").alias("score"),
                          ((F.col("_guess.lang") == UNKNOWN) | (F.col("_guess.score") < min_lead)).alias("rejected"))
