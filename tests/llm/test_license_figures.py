"""Recall and precision of the licence scan by template, on edited copies within prose that also uses licence words."""

import random
from collections import defaultdict

from plumbline.llm import licenses

EDITS = (0.0, 0.05, 0.1, 0.15)
COPIES = 12


def edited(rng, words, share, other):
    """``words`` with that share of them replaced, left out or preceded by another."""
    out = []
    chosen = set(rng.sample(range(len(words)), int(share * len(words))))
    for k, w in enumerate(words):
        if k in chosen:
            way = rng.randrange(3)
            out += [rng.choice(other)] if way == 0 else [] if way == 1 else [rng.choice(other), w]
        else:
            out.append(w)
    return out


def in_order(a, b):
    """The most words of ``a`` found in order in ``b``."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


def shuffled(rng, words):
    """``words`` in another order that holds too few of them in their own to be a copy."""
    while True:
        out = rng.sample(words, len(words))
        if in_order(words, out) < licenses.COVERAGE * len(words):
            return out


def planted():
    """(id, text, template, share edited) with copies, and texts without: the second half of a template, its words in another order."""
    rng = random.Random(8)
    legal = sorted({w for t in licenses.TEMPLATES.values() for w in t.split()})
    prose = [f"w{k}" for k in range(300)]
    around = lambda: [rng.choice(prose if rng.random() < 0.7 else legal) for _ in range(rng.randint(20, 80))]
    rows = []
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        for share in EDITS:
            for _ in range(COPIES):
                rows.append((len(rows), " ".join(around() + edited(rng, words, share, prose) + around()), name, share))
        half = words[len(words) // 2 :]  # the first half of the Apache notice is the whole statement
        rows += [(len(rows) + k, " ".join(around() + half + around()), None, None) for k in range(COPIES)]
        rows += [(len(rows) + k, " ".join(around() + shuffled(rng, words) + around()), None, None) for k in range(COPIES)]
    return rows


def figures(spark):
    rows = planted()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(8)
    found = defaultdict(set)
    for r in licenses.scan(docs).collect():
        found[r.doc_id].add(r.license)
    recall, right, all_found = defaultdict(list), defaultdict(int), defaultdict(int)
    for key, _, name, share in rows:
        if name:
            recall[name, share].append(name in found[key])
        for x in found[key]:
            # the long notice starts with the short statement
            right[x] += x == name or (x, name) == ("Apache-2.0-statement", "Apache-2.0-notice")
            all_found[x] += 1
    return {k: sum(v) / len(v) for k, v in recall.items()}, {x: right[x] / n for x, n in all_found.items()}


def test_recall_and_precision(spark):
    recall, precision = figures(spark)
    for name in licenses.TEMPLATES:
        print(name, [round(recall[name, s], 2) for s in EDITS], round(precision[name], 3))
    assert all(v == 1 for (_, s), v in recall.items() if s <= 0.05)
    assert all(v >= 0.9 for (_, s), v in recall.items() if s <= 0.1)
    assert set(precision) == set(licenses.TEMPLATES) and min(precision.values()) >= 0.95
