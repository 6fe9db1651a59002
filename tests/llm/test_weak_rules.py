import random
import re
from collections import Counter

from tracewell.llm import weak_rules


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def plain_votes(t):
    t = t or ""
    n_words, word_chars, n_symbols, n_dup, n_again = brute(t)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
    per = lambda a, b: a / max(b, 1)
    capitals, marks = sum("A" <= c <= "Z" for c in t), t.count("!") + t.count("?")

    def vote(value, good, bad):
        return 0 if bad(value) else 1 if good(value) else None

    return [
        vote(n_words, lambda x: x >= 60, lambda x: x < 20),
        vote(per(word_chars, n_words), lambda x: 2.5 <= x <= 9, lambda x: x < 1.5 or x > 12),
        vote(per(n_symbols, n_words), lambda x: x < 0.02, lambda x: x > 0.1),
        vote(per(n_dup, lines), lambda x: x < 0.05, lambda x: x > 0.3),
        vote(per(n_again, n_words), lambda x: x < 0.05, lambda x: x > 0.2),
        vote(per(capitals, word_chars), lambda x: x < 0.15, lambda x: x > 0.4),
        vote(per(marks, n_words), lambda x: x < 0.1, lambda x: x > 0.3),
    ]


def plain_posteriors(texts, rounds=200):
    """EM over single rows, in probabilities."""
    votes = [plain_votes(t) for t in texts]
    good = [0.1 if 0 in v else 0.95 for v in votes]
    for _ in range(rounds):
        share = (sum(good) + 1) / (len(good) + 2)
        says = []  # probability of a good vote for good and for bad rows
        for r in range(7):
            yes = [[1.0, 1.0], [1.0, 1.0]]
            for p, v in zip(good, votes):
                if v[r] is not None:
                    yes[1][v[r]] += p
                    yes[0][v[r]] += 1 - p
            says.append([yes[k][1] / (yes[k][0] + yes[k][1]) for k in (0, 1)])
        new = []
        for v in votes:
            a, b = share, 1 - share
            for x, (bad, fine) in zip(v, says):
                if x is not None:
                    a, b = a * (fine if x else 1 - fine), b * (bad if x else 1 - bad)
            new.append(a / (a + b))
        moved = max(abs(x - y) for x, y in zip(good, new))
        good = new
        if moved < 1e-9:
            break
    return good


def test_counts_by_brute_force(spark):
    rnd = random.Random(7)
    texts = [None, "", " \n\x0b", "a", "é ß\x1cx y", "a b c d e f g h " * 3, "a " * 40, "x\ny\nx\n\n x\ny", " ".join(f"w{i % 7001}" for i in range(60_000)), "z" * 400_000]
    for _ in range(60):
        base = [rnd.choice("abcdefgh") + rnd.choice(["", "!", "*", "#", "é"]) for _ in range(rnd.randint(0, 60))]
        k = rnd.randint(0, max(0, len(base) - 12))
        texts.append("".join(x + rnd.choice([" ", "\n", "\t ", "\r\n"]) for x in base + base[k : k + rnd.randint(0, 14)]))
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "null id", 1), (3, "a", 1)]
    got = weak_rules.digest(weak_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, n_words int"))).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r[:6]) for r in got), key=key) == sorted(((i, *brute(t)) for i, t, _ in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert weak_rules.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_em_recovers_accuracies():
    rnd = random.Random(1)
    acc = [(0.98, 0.7), (0.95, 0.6), (0.9, 0.8), (0.99, 0.5)]  # share of right votes on good and on bad rows
    rows = []
    for _ in range(20000):
        y = rnd.random() < 0.8
        rows.append((y, tuple(None if rnd.random() < 0.1 else int(y if rnd.random() < (a if y else b) else not y) for a, b in acc)))
    prior, odds = weak_rules.estimate(list(Counter(v for _, v in rows).items()))
    right = sum((prior + sum(o[0] if v else o[1] for v, o in zip(votes, odds) if v is not None) > 0) == y for y, votes in rows)
    assert right / len(rows) > 0.94


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in weak_rules.judged(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    pairs = [(kept[r.doc_id], r.quality == 1) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.9
