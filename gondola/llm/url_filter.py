"""URL filter: fixed rules first, then naive Bayes over the words inside hosts and paths.

Hosts write words together (``cheappillsonline``). A Viterbi pass over a unigram model of
words splits every run of letters into its likeliest words; a multinomial naive Bayes
model over these words then tells hosts to block from the others.

The unigram model counts the words of all pages' texts, their markup removed. Of these,
words with at least ``LEAST_SHARE`` of all occurrences are kept, hence at most
``1 / LEAST_SHARE`` words whatever the size of the table, and every topic word is kept with
at least that share. A run of letters that is no known word costs its length.

The naive Bayes model is learned from weak labels over all URLs: a URL counts as an example to
block if a word of its host is one of ``TOPIC_WORDS`` (a parameter), and as one to allow if not.
What shares hosts with topic words is thereby learned as well, and a topic word that turns
out common in other URLs loses its weight. Tokens are the words of host and path and ``#``
for a run of digits; those under the least share are counted together, and one that no URL
of the fit had says nothing. Both classes are smoothed towards the tokens' overall shares,
by as many occurrences as there are tokens with a count: even shares would lean rare tokens
to the smaller class. Counts are summed in Spark over all rows; only the bounded model is
broadcast.

Nulls: a URL that is null or has no ``://`` has an empty host and path, fits no rule, has
no token and is judged by the prior alone, which allows it unless most URLs are to be
blocked; a null ``page_id`` stays. Very long hosts and paths are read whole, in time
proportional to their length. Ties: equally likely splits prefer fewer, then longer first
words; equal scores of both classes allow; equally long rules go by their text. Repeated
rows are judged like others, and weigh in the counts. An empty table gives no rows. Further
columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules, as verdict, host and path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Words of hosts that one would block, by topic.
TOPIC_WORDS = frozenset(
    "casino casinos poker slots bet bets betting gambling jackpot lottery roulette "
    "adult porn porno sex sexy xxx nude nudes escort escorts webcam "
    "pill pills pharma pharmacy viagra cialis meds steroids "
    "spam spammer phishing malware warez crack cracks keygen torrent torrents "
    "ad ads adserver adware banner banners popup popups tracker tracking doubleclick".split())

#: Least share of all occurrences for a word or token to have a count of its own.
LEAST_SHARE = 2e-6
LONGEST_WORD = 24

RARE = ""  # stands for all tokens under the least share
DIGITS = "#"
PIECES = re.compile(r"[^\W\d_]+|[0-9]+")
LETTERS, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- parts and rules ---------------------------------------------------------------


def with_parts(pages: DataFrame) -> DataFrame:
    """Page key, host and path of every URL."""
    parts = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
    ).withColumn("at", F.instr("url", "://")).withColumn(
        "rest", F.when(F.col("at") > 0, F.expr("substring(url, at + 3)")).otherwise("")
    ).withColumn("host", F.regexp_extract("rest", r"\A[^/?#]*", 0)).withColumn(
        "path", F.regexp_extract(F.expr("substring(rest, length(host) + 1)"), r"\A[^?#]*", 0))
    return parts.select("page_id", F.translate("host", LETTERS, LOWER).alias("host"), "path")


def rule_of(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct of verdict and text of the longest rule that fits host and path, or null."""
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, host, path in sorted(
            rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        chosen = F.when(fits & F.col("path").startswith(path), F.struct(
            F.lit(verdict).alias("verdict"), F.lit(host + path).alias("rule"))).otherwise(chosen)
    return chosen


# --- words ---------------------------------------------------------------------------


def word_counts(pages: DataFrame) -> DataFrame:
    """How often each word occurs in the pages' texts: ``word`` and ``count``."""
    text = F.lower(F.regexp_replace(
        F.coalesce(F.col("html").cast("string"), F.lit("")), r"<[^<>]*>", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word"))
    return words.filter((F.col("word") != "") & (F.length("word") <= LONGEST_WORD)).groupBy(
        "word").agg(F.count("*").alias("count"))


def _frequent(counts: DataFrame, key: str, total: Column, share: float) -> DataFrame:
    """Rows with at least a share of the whole, at most ``1 / share`` of them."""
    whole = counts.agg(F.sum(total)).scalar()
    return counts.withColumn("whole", whole).filter(total >= F.col("whole") * share)


def fit_words(pages: DataFrame, topics: frozenset[str] = TOPIC_WORDS,
              share: float = LEAST_SHARE) -> dict[str, float]:
    """Log10 chance of every frequent word and of every topic word; under ``RARE`` that of
    an unknown letter's first, see ``split_words``."""
    counts = word_counts(pages)
    rows = _frequent(counts, "word", F.col("count"), share).collect()
    whole = rows[0]["whole"] if rows else 1
    least = max(1.0, whole * share)
    known = {row["word"]: row["count"] for row in rows}
    for word in topics:
        known[word] = max(known.get(word, 0), least)
    words = {word: math.log10(count / (whole + len(topics) * least))
             for word, count in known.items()}
    words[RARE] = math.log10(1 / (whole + 1))
    return words


def split_words(run: str, words: dict[str, float]) -> list[str]:
    """The likeliest split of a run of letters.

    A piece that is no known word has the chance of one occurrence, times a tenth for each
    of its letters.
    """
    unknown = words[RARE]
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # score, minus pieces, last length
    for end in range(1, len(run) + 1):
        chosen = None
        for size in range(1, min(end, LONGEST_WORD) + 1):
            before = best[end - size]
            score = words.get(run[end - size:end])
            if score is None:
                score = unknown - size
            # A longer first word means a shorter last one.
            found = (before[0] + score, before[1] - 1, -size)
            if chosen is None or found > chosen:
                chosen = found
        best.append(chosen)
    pieces, end = [], len(run)
    while end:
        size = -best[end][2]
        pieces.append(run[end - size:end])
        end -= size
    return pieces[::-1]


CACHED_RUNS = 1 << 16


def _splitter(words: dict[str, float]) -> Callable[[str], list[str]]:
    """``tokens(text)``, remembering the runs it has split, up to ``CACHED_RUNS``."""
    known: dict[str, list[str]] = {}

    def tokens(text: str) -> list[str]:
        found = []
        for run in PIECES.findall(text):
            if run[0].isdecimal():
                found.append(DIGITS)
                continue
            pieces = known.get(run)
            if pieces is None:
                pieces = split_words(run, words)
                if len(known) >= CACHED_RUNS:
                    known.clear()
                known[run] = pieces
            found += pieces
        return found
    return tokens


# --- naive Bayes -----------------------------------------------------------------------


@dataclass(frozen=True)
class UrlModel:
    """Words with their log chances, log odds to block per token, and those of the prior."""

    words: dict[str, float]
    odds: dict[str, float]
    prior: float


SUMMED = 1 << 16


def _count_tokens(words, topics: frozenset[str]) -> Callable:
    """Per token, its number in URLs to block and in others; the number of URLs under null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _splitter(words.value)
        counts: dict[str | None, list[int]] = {}

        def summed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(list(counts), pa.string()),
                pa.array([c[0] for c in counts.values()], pa.int64()),
                pa.array([c[1] for c in counts.values()], pa.int64())],
                ["token", "allowed", "blocked"])

        for batch in batches:
            for host, path in zip(*(column.to_pylist() for column in batch.columns)):
                in_host = tokens(host)
                label = not topics.isdisjoint(in_host)
                for token in (None, *in_host, *tokens(path.lower())):
                    counts.setdefault(token, [0, 0])[label] += 1
                if len(counts) >= SUMMED:
                    yield summed()
                    counts.clear()
        if counts:
            yield summed()
    return run


def fit_urls(parts: DataFrame, words: dict[str, float], topics: frozenset[str] = TOPIC_WORDS,
             share: float = LEAST_SHARE) -> UrlModel:
    """Learn which tokens go with hosts to block, from all URLs that have a host."""
    sent = parts.sparkSession.sparkContext.broadcast(words)
    counted = parts.filter("host <> ''").select("host", "path").mapInArrow(
        _count_tokens(sent, topics), "token string, allowed long, blocked long",
    ).groupBy("token").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    both = F.col("allowed") + F.col("blocked")
    # The rest of the tokens is one sum; the kept ones are bounded by the share.
    named = F.col("token").isNotNull()
    whole = counted.filter(named).agg(F.sum(both)).scalar()
    kept = F.when(both >= whole * share, F.col("token")).when(named, RARE)
    rows = counted.select(kept.alias("token"), "allowed", "blocked").groupBy("token").agg(
        F.sum("allowed"), F.sum("blocked")).collect()
    table = {token: (allowed, blocked) for token, allowed, blocked in rows}
    n_allowed, n_blocked = table.pop(None, (0, 0))
    of_allowed, of_blocked = (sum(c[k] for c in table.values()) for k in (0, 1))
    share_of = {token: sum(c) * len(table) / (of_allowed + of_blocked) for token, c in table.items()}
    odds = {token: math.log((b + share_of[token]) / (of_blocked + len(table)))
            - math.log((a + share_of[token]) / (of_allowed + len(table)))
            for token, (a, b) in table.items()}
    return UrlModel(words, odds, math.log((n_blocked + 1) / (n_allowed + 1)))


def _score(model) -> Callable:
    words, odds, prior = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, of = _splitter(words.value), odds.value
        rare = of.get(RARE, 0.0)
        for batch in batches:
            host, path = (batch.column(name).to_pylist() for name in ("host", "path"))
            found = [[*tokens(h), *tokens(p.lower())] for h, p in zip(host, path)]
            scores = [prior + math.fsum(of.get(t, rare) for t in row) for row in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.string())), pa.array(scores, pa.float64())],
                [*batch.schema.names, "tokens", "log_odds"])
    return run


def judged(parts: DataFrame, model: UrlModel,
           rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Verdict of every page, with the rule that gave it, the tokens and their log odds."""
    context = parts.sparkSession.sparkContext
    sent = context.broadcast(model.words), context.broadcast(model.odds), model.prior
    scored = parts.select("page_id", "host", "path").mapInArrow(
        _score(sent), "page_id long, host string, path string, tokens array<string>, log_odds double")
    by_method = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return scored.withColumn("chosen", rule_of(rules)).select(
        "page_id", "host", "path", F.col("chosen.rule").alias("rule"),
        F.coalesce("chosen.verdict", by_method).alias("verdict"), "tokens", "log_odds")


def judge_pages(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES,
                topics: frozenset[str] = TOPIC_WORDS) -> DataFrame:
    """Learn words and URLs from all pages, then judge each page."""
    parts = with_parts(pages)
    return judged(parts, fit_urls(parts, fit_words(pages, topics), topics), rules)
