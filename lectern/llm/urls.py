"""URL filters: segmented host words under multinomial naive Bayes, after rules.

A host's labels are strings of words written together.  A unigram model splits
each into its likeliest words (Viterbi; a piece that is no known word costs by
its length).  Multinomial naive Bayes over the words of host and path says
whether a URL is to be blocked; all unknown pieces count as one word.  Both
models are counted on labelled URLs made by rule, of which one in four is to be
blocked.  Where rules fit, the longest decides instead.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.labelled_urls import common_counts, labelled_urls
from lectern.llm.shared import prepare_workers, tidy

ALLOW, BLOCK = "allow", "block"
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")
#: Letters of the longest piece that the segmentation considers.
LONGEST_WORD = 24
#: Letters of words that are met inside others by chance, and from which on a word beside one is no such piece itself.
EASILY_MET, SHORT = 4, 3
#: What unknown pieces and numbers count as.
UNKNOWN, NUMBER = "?", "#"


def words_of(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text.lower()) if w]


@dataclass
class Filter:
    """Costs of words for segmentation, and per word the log odds of blocking."""

    costs: dict[str, float]
    odds: dict[str, float]
    prior: float
    unknown_cost: float  # of a piece that is no word
    letter_cost: float  # and of each of its letters

    def segment(self, label: str) -> tuple[str, ...]:
        """The likeliest words that a string of letters is made of; digits stand by themselves."""
        return tuple(w for part in words_of(label) for w in _split(self, part))

    def words(self, host: str, path: str) -> list[str]:
        return [w for part in (*host.split("."), *words_of(path)) for w in self.segment(part)]

    def evidence(self, host: str, path: str) -> list[str]:
        """The words that count: a short one that speaks for blocking does so only where it surely is a word."""
        return [w for label in (*host.split("."), path) for part in words_of(label) for w in self.firm(_split(self, part))]

    def firm(self, pieces: list[str]) -> list[str]:
        """Pieces of letters written together; short ones that speak for blocking are unknown unless known words, none of them short itself, are on both sides.

        Three letters turn up inside other words by chance (essex, better), and the pieces
        around them then are short or no words.  At an end of the letters nothing has to be there.
        """
        sure = [w in self.costs and len(w) >= SHORT for w in pieces]
        out = []
        for i, w in enumerate(pieces):
            chance = len(pieces) > 1 and len(w) <= EASILY_MET and self.odds_of(w) > 0 and not all(sure[j] for j in (i - 1, i + 1) if 0 <= j < len(pieces))
            out.append(UNKNOWN if chance else w)
        return out

    def odds_of(self, word: str) -> float:
        return self.odds.get(word, self.odds[NUMBER if word.isdecimal() else UNKNOWN])

    def log_odds(self, words: list[str]) -> float:
        return self.prior + sum(map(self.odds_of, words))

    def verdict(self, host: str, path: str) -> str:
        return BLOCK if self.log_odds(self.evidence(host, path)) > 0 else ALLOW


def _split(model: Filter, text: str) -> list[str]:
    if text.isdecimal():
        return [text]
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        best.append(min((best[start][0] + model.costs.get(piece := text[start:end], model.unknown_cost + model.letter_cost * len(piece)), start) for start in range(max(0, end - LONGEST_WORD), end)))
    out, end = [], len(text)
    while end:
        start = best[end][1]
        out.append(text[start:end])
        end = start
    return out[::-1]


def train(labelled: list[tuple[list[str], bool]], words: dict[str, int] | None = None, least: int = 3) -> Filter:
    """Unigram costs (-log p) and naive Bayes log odds with add-one smoothing.

    ``words`` are counts that word costs take in besides.  What comes fewer than
    ``least`` times is unknown; the cost of an unknown piece follows from how many
    of these there are, with one of 26 letters at each place.
    """
    counts = {True: Counter(), False: Counter()}
    for held, block in labelled:
        counts[block].update(NUMBER if w.isdecimal() else w for w in held)
    every = counts[True] + counts[False]
    rare = [w for w, n in every.items() if n < least and w != NUMBER]
    unknown = sum(every[w] for w in rare) + 1
    for side in counts.values():
        side[UNKNOWN] = sum(side.pop(w, 0) for w in rare)
    kept = {w for w, n in every.items() if n >= least} | {UNKNOWN, NUMBER}
    known = Counter({w: n for w, n in every.items() if n >= least and w != NUMBER}) + Counter(words or {})
    total = sum(known.values()) + unknown
    size = {block: sum(c.values()) + len(kept) for block, c in counts.items()}
    odds = {w: math.log((counts[True][w] + 1) / size[True]) - math.log((counts[False][w] + 1) / size[False]) for w in kept}
    blocked = sum(block for _, block in labelled)
    return Filter({w: -math.log(n / total) for w, n in known.items()}, odds, math.log((blocked + 1) / (len(labelled) - blocked + 1)), -math.log(unknown / total), math.log(26))


@lru_cache(maxsize=1)
def default_filter() -> Filter:
    return train(labelled_urls(), common_counts())


#: (verdict, host, path); a rule fits its host and all subdomains of it, if the path starts with the rule's.
Rule = tuple[str, str, str]


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", model: Filter | None = None) -> DataFrame:
    """Every row of ``pages`` with a verdict on its URL.

    Returns ``row`` (a struct of all columns, so no name can clash), ``host``
    (after the first :// up to / ? # or the end, A-Z lower-cased), ``path`` (then
    up to ? # or the end), ``rule`` (host and path of the longest rule that
    fits, of equal ones the first; else null), ``words`` (what host and path are
    split into) and ``verdict`` (the rule's, else the classifier's).  Null URLs
    and those without :// have an empty host and path, which no rule fits unless
    it is empty itself.  Repeated rows each have their result; an empty table
    gives an empty result.
    """
    prepare_workers(pages.sparkSession)
    model = model or default_filter()
    url = F.coalesce(F.col("row")[url_col].cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.when(rest.isNotNull(), F.expr("substring(u, length(f) + 4)")).otherwise(F.lit(""))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row")).withColumn("u", url).withColumn("f", rest).withColumn("a", after)
    host = F.regexp_extract("a", r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract("a", r"(?s)^[^/?#]*([^?#]*)", 1)
    rows = rows.select("row", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))
    fitting = lambda i, h, p: F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.lit(i))
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), i))
    rows = rows.withColumn("hit", F.coalesce(*(fitting(i, *rules[i][1:]) for i in ranked), F.lit(-1)))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {}

        def segmented(part: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
            """(words, those that count) of a run of letters and digits."""
            if part not in known:
                if len(known) > 100_000:
                    known.clear()
                pieces = _split(model, part)
                known[part] = tuple(pieces), tuple(model.firm(pieces))
            return known[part]

        for frame in frames:
            held = [[segmented(part) for label in (*h.split("."), p) for part in words_of(label)] for h, p in zip(frame["host"], frame["path"], strict=True)]
            words = [[w for pieces, _ in parts for w in pieces] for parts in held]
            said = [BLOCK if model.log_odds([w for _, firm in parts for w in firm]) > 0 else ALLOW for parts in held]
            hits = frame["hit"].tolist()
            yield frame.drop(columns="hit").assign(rule=[rules[i][1] + rules[i][2] if i >= 0 else None for i in hits], words=words, verdict=[rules[i][0] if i >= 0 else v for i, v in zip(hits, said, strict=True)])

    schema = T.StructType([*rows.drop("hit").schema, T.StructField("rule", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("verdict", T.StringType())])
    return rows.mapInPandas(tidy(each), schema)
