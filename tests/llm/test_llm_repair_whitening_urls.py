"""Conversation repair, whitening and URL filter against plain versions of each."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.llm import conversation_repair as repair
from gondola.llm import url_filter, whitening

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\v\f\r"


# --- conversations -------------------------------------------------------------------


def plain_cheapest(rows):
    """Search by cost, then by edit string, over (rows used, roles written, text)."""
    # Each row: initial, must be deleted, cut off.
    heap = [(0, "", 0, "")]
    done = set()
    while heap:
        cost, edits, at, roles = heapq.heappop(heap)
        state = roles[:1] == "s", len(roles) == 1 and roles == "s", roles[-1:]
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, edits
        options = [(3, "I", at, roles + r) for r in "ua"]
        if at < len(rows):
            initial, gone, cut = rows[at]
            options.append((4, "D", at + 1, roles))
            if not gone:
                options.append((3 * cut, "K", at + 1, roles + (initial or "?")))
                options += [(3 + 3 * cut, "R", at + 1, roles + r) for r in "ua"]
        for more, letter, then, new in options:
            if re.fullmatch(r"s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, edits + letter, then, new))


def plain_repair(rows):
    """The whole result of one conversation from its damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (
        r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, faults, symbols = set(), Counter(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                 else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
        faults[fault] += 1
        symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, edits = plain_cheapest(symbols)
    out, at, wanted = [], 0, {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    roles = ""
    for letter in edits:
        role, text = "", ""
        if letter != "I":
            _, role, text = rows[at]
            at += 1
        if letter == "D":
            continue
        if letter != "K":
            role = full[wanted[roles[-1:]]]
        roles += role[:1]
        out.append(f"{role}:{text}")
    assert re.fullmatch(r"(s?(ua)+)?", roles)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    """Damaged rows per conversation; a conversation that lost all its rows stays."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        fate, found = zlib.crc32(key.encode()) % 20, out[conv]
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        found += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def repaired(rows, damage):
    names = ["conv_id", *repair.FIGURES, "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r)[1:] for r in repair.repair_digests(damage(rows)).select(*names).collect()}


def test_tables_agree_with_single_steps():
    tables = repair.Tables(3)
    draw = random.Random(1)
    assert len(tables.vectors) < 256 and all(min(v) == 0 for v in tables.vectors)
    for _ in range(200):
        codes = [draw.randrange(repair.SYMBOLS) for _ in range(3)]
        at = draw.randrange(len(tables.vectors))
        costs = tables.vectors[at]
        for code in reversed(codes):
            costs = repair.before(code, costs)
        number = int(codes[0] * repair.SYMBOLS ** 2 + codes[1] * repair.SYMBOLS + codes[2])
        after = tables.vectors[tables.to[number, at]]
        assert tuple(c + tables.cost[number, at] for c in after) == costs


@pytest.mark.parametrize("block", [1, 2, 4])
def test_edits_are_the_least_of_the_cheapest(block):
    tables, draw = repair.Tables(block), random.Random(block)
    for n in list(range(0, 9)) * 25:
        rows = [(draw.choice("suuaax"), draw.random() < 0.2, draw.random() < 0.2) for _ in range(n)]
        codes = bytes(0 if gone else repair.symbol(i, cut) for i, gone, cut in rows)
        cost, edits = tables.cheapest(codes)
        assert (cost, edits.decode()) == plain_cheapest(rows)


def test_repair_of_the_given_conversations(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = {c: plain_repair(rows) for c, rows in plain_damage(map(tuple, table.select(
        "conv_id", "turn", "role", "text").collect())).items()}
    assert repaired(table, repair.damaged) == want


ODD = [
    (None, 1, "user", "hello."), (None, None, None, None), (None, 1, "user", "hello."),
    (1, None, "assistant", "Null turns first."), (1, 0, "user", "no end"), (1, 0, "user", "No end?"),
    (1, 0, "User", "Other case."), (2, 5, "", "No role."), (2, 5, None, "x"), (2, 9, "system", " \t"),
    (3, -4, "system", "Long. " * 200_000), (3, 7, "user", "Long. " * 200_000 + "\n"),
    (3, 8, "user", "Größe…"), (3, 9, "assistant", "\u00a0"), (3, 9, "assistant", "\u00a0"),
    *[(4, 3, "user", "Again.")] * 50, *[(5, k, "assistant", "Again.") for k in range(40)],
    *[(6, k, "user" if k % 2 else "assistant", f"Turn {k}.") for k in range(200)],
]


def test_repair_of_odd_rows(spark):
    draw = random.Random(9)
    rows = draw.sample(ODD, len(ODD))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {name: F.lit("clash") for name in ("kind", "digest", "copies", "figures", "audit", "initial", "copy")})
    assert repaired(table, repair.damaged) == {c: plain_repair(r) for c, r in plain_damage(rows).items()}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert repaired(table, repair.undamaged) == {c: plain_repair(r) for c, r in groups.items()}
    texts = defaultdict(list)
    for r in repair.repaired_rows(repair.undamaged(table)).orderBy("place").collect():
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, r in groups.items():
        assert hashlib.sha256("\n".join(texts[conv]).encode()).hexdigest() == plain_repair(r)[-1]
    assert repair.repair_digests(repair.damaged(table.where("turn > 999"))).count() == 0


def test_a_conversation_that_loses_all_its_rows(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert repaired(table, repair.damaged) == {
        gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# --- whitening -------------------------------------------------------------------------


def plain_whitening(vectors):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, q = np.linalg.eigh(centred.T @ centred / n)
    values, q = values[::-1][:8], q[:, ::-1][:, :8]
    return centred @ q / np.sqrt(values), ((n * x - sums) ** 2).sum(axis=1), values / np.var(x, axis=0).sum()


def by_row(got, keys):
    rows = defaultdict(dict)
    for r in got.collect():
        rows[r.vec_id][r.component] = r
    assert set(rows) == set(keys)
    return rows


@pytest.mark.parametrize("entries,tasks", [(1 << 17, 16), (640, 2)])
def test_whitening_of_the_given_vectors(spark, monkeypatch, entries, tasks):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", tasks)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    given = sorted((r.vec_id, r.embedding) for r in table.collect())
    want, deviations, explained = plain_whitening([v for _, v in given])
    rows = by_row(whitening.whitened(table), [k for k, _ in given])
    got = np.array([[rows[k][c].whitened for c in range(1, 9)] for k, _ in given])
    assert np.allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-9)
    one = rows[given[0][0]]
    assert np.allclose([one[c].explained for c in range(1, 9)], explained)
    assert 0 <= one[1].identity_error < 1e-9 and one[1].n == len(given)
    assert [rows[k][1].deviation for k, _ in given] == deviations.tolist()


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k % 5), float(k * k % 7), 0.25]) for k in range(40)]
    rows = good + [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]),
                   (104, [1.0, -inf, 1.0]), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {name: F.lit("clash") for name in ("x", "block", "n", "length", "entry", "component")})
    found = by_row(whitening.whitened(table), [k for k, _ in good])
    x = np.floor(np.array([v for _, v in good]) * 1024).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    assert [found[k][3].whitened for k, _ in good] == [0.0] * n  # no spread is left
    assert found[0][1].identity_error == pytest.approx(1.0)
    assert [found[k][2].deviation for k, _ in good] == ((n * x - sums) ** 2).sum(axis=1).tolist()
    first = np.array([found[k][1].whitened for k, _ in good])
    assert first @ first / n == pytest.approx(1.0) and abs(first.mean()) < 1e-9
    assert whitening.whitened(table.where("vec_id > 99")).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened(table.where("vec_id = 101")).count() == 0


def test_whitening_of_repeated_and_huge_rows(spark):
    alone = spark.createDataFrame([(None, [0.5, 1.5])] * 3, "vec_id long, embedding array<double>")
    got = whitening.whitened(alone).collect()
    assert len(got) == 6 and {r.whitened for r in got} == {0.0} and {r.n for r in got} == {3}
    assert {(r.vec_id, r.deviation, r.explained, r.identity_error) for r in got} == {(None, 0, 0.0, 1.0)}
    wide = spark.createDataFrame([(0, [1e12, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 1.0])],
                                 "vec_id long, embedding array<double>")
    rows = by_row(whitening.whitened(wide), [0, 1, 2])
    assert rows[0][1].deviation is None  # past a long
    assert rows[0][1].whitened == pytest.approx(math.sqrt(2))


# --- URLs ------------------------------------------------------------------------------


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http:///de/", "HTTP://Example.NET/en/x?y#z", "a://b://net/",
    "http://net", "http://net/", "http://xnet/", "http://a.net?x/en/", "http://example.net/EN/",
    "http://www.example.net/en/", "https://example.com/de", "https://m.example.com/de/#", "x://org/fr/",
    "x://my.org/fr/fr/", "x://ÀÉ.Org/fr/é", "x://cheap-pills.org/en/1", "x://cheappills.org/buy/now",
    "x://freebetscasino.com/en/2", "http://user@Example.com:80/de/", "x://a\nb.net/\n/en/?", "x://wort.org/de/wort",
    "x://" + "ab" * 30_000 + ".org/" + "cd" * 30_000,
]


def test_parts_and_rules(spark):
    table = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns(
        {name: F.lit("clash") for name in ("host", "path", "rest", "at", "rule", "verdict", "word")})
    got = {r.page_id: r for r in url_filter.with_parts(table).withColumn(
        "c", url_filter.rule_of(url_filter.RULES)).collect()}
    for k, url in enumerate(URLS):
        assert (got[k].host, got[k].path) == plain_parts(url), url
        rule, verdict = plain_rule(got[k].host, got[k].path)
        assert got[k].c == (None if rule is None else (verdict, rule)), url


def every_split(run):
    if not run:
        yield []
    for size in range(1, len(run) + 1):
        for rest in every_split(run[size:]):
            yield [run[:size], *rest]


def test_splits_are_the_likeliest():
    words = {"cheap": -2.0, "pills": -2.5, "pill": -2.2, "s": -3.0, "on": -1.0, "line": -1.5,
             "online": -2.5, "a": -1.0, "aa": -2.0, url_filter.RARE: -6.0}
    for run in ["cheappills", "online", "aaaa", "onxline", "q", "pillss", "qqaa"]:
        def score(pieces):
            known = sum(words[p] if p in words else words[url_filter.RARE] - len(p) for p in pieces)
            return round(known, 9), -len(pieces), [len(p) for p in pieces]
        assert url_filter.split_words(run, words) == max(every_split(run), key=score)
    assert "".join(url_filter.split_words("x" * 100, words)) == "x" * 100


def plain_model(rows):
    """Words, log odds and prior from all rows, without Spark."""
    counts = Counter(w for _, _, html in rows for w in re.split(
        r"[\W\d_]+", re.sub("<[^<>]*>", " ", html or "").lower()) if w and len(w) <= 24)
    whole, share = sum(counts.values()), url_filter.LEAST_SHARE
    least = max(1.0, whole * share)
    known = {w: n for w, n in counts.items() if n >= whole * share}
    for w in url_filter.TOPIC_WORDS:
        known[w] = max(known.get(w, 0), least)
    words = {w: math.log10(n / (whole + len(url_filter.TOPIC_WORDS) * least)) for w, n in known.items()}
    words[url_filter.RARE] = math.log10(1 / (whole + 1))
    tokens = []
    for _, url, _ in rows:
        host, path = plain_parts(url)
        sides = [[p for run in re.findall(r"[^\W\d_]+|[0-9]+", t) for p in (
            ["#"] if run[0].isdecimal() else url_filter.split_words(run, words))] for t in (host, path.lower())]
        tokens.append((host, *sides))
    of = (Counter(), Counter())
    urls = [0, 0]
    for host, in_host, in_path in tokens:
        if host:
            label = bool(url_filter.TOPIC_WORDS & set(in_host))
            urls[label] += 1
            of[label].update(in_host + in_path)
    both, size = of[0] + of[1], len(of[0] | of[1])
    shares = {t: n * size / both.total() for t, n in both.items()}
    odds = {t: math.log((of[1][t] + shares[t]) / (of[1].total() + size))
            - math.log((of[0][t] + shares[t]) / (of[0].total() + size)) for t in both}
    prior = math.log((urls[1] + 1) / (urls[0] + 1))
    return [prior + sum(odds.get(t, 0.0) for t in a + b) for _, a, b in tokens]


def test_verdicts_of_the_given_pages(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [tuple(r) for r in table.select("page_id", "url", "html").collect()]
    got = {r.page_id: r for r in url_filter.judge_pages(table).collect()}
    for (page, url, _), score in zip(rows, plain_model(rows)):
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        assert (got[page].host, got[page].path, got[page].rule) == (host, path, rule)
        assert got[page].log_odds == pytest.approx(score)
        assert got[page].verdict == (verdict or ("block" if score > 0 else "allow"))


def test_hosts_of_joined_topic_words(spark):
    names = "tionsh ththre thther tionble therand wortlich".split()
    rows = [(k, f"http://{names[k % 6]}.example.org/en/{k}", "<p>cheap words, online now</p>") for k in range(300)]
    rows += [(300 + k, f"http://cheap{w}now.example.org/en/{k}", None)
             for k, w in enumerate(["pills", "casino", "pills"])]
    rows += [(k + 400, url, "") for k, url in enumerate(URLS)] + [(None, "x://clean.org/en/", "<" * 50_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "token", F.lit("clash")).withColumn("count", F.lit(1))
    got = url_filter.judge_pages(table).select("page_id", "verdict", "rule").collect()
    assert len(got) == len(rows)
    blocked = {r.page_id for r in got if r.verdict == "block" and r.rule is None}
    assert blocked >= {300, 301, 302, 418, 419, 420}
    assert not blocked & {*range(300), 400, 401, 402, 403, 423, 424, None}
    assert url_filter.judge_pages(table.where("page_id > 9999")).count() == 0
