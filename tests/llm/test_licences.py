import math
import random
from collections import Counter

import pytest

from pitchlytics.llm import licences as L

MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
PLAIN = ["some words about a house.", "the tree and the river", "another line of text. And more"]


def cosine(scanner, a, b):
    u, v = (({t: n * scanner.idf(t) for t, n in Counter(L.terms(x)).items()}) for x in (a, b))
    dot = sum(w * v.get(t, 0) for t, w in u.items())
    return dot / math.sqrt(sum(w * w for w in u.values()) * sum(w * w for w in v.values()))


@pytest.fixture(scope="module")
def scanner():
    return L.Scanner(1000, {"the": 900, "under": 300, "released": 20, "license": 30, "3": 200, "is": 700, "work": 100, "this": 500})


def test_every_template_finds_itself(scanner):
    for name, text in L.TEMPLATES:
        got = scanner.find(f"First words here.\n{text}\nLast words.")
        assert got[0] == name and got[1] == pytest.approx(1.0), (name, got)


def test_telling_terms_lose_nothing(scanner):
    """A stretch without a telling term can't reach the threshold with any template."""
    for name, text in L.TEMPLATES:
        rest = " ".join(t for t in L.terms(text) if t not in scanner.telling)
        if rest:
            assert cosine(scanner, rest, text) < scanner.least, name


def test_scores_are_cosines_and_the_best_wins(scanner):
    for text in ("Licensed under the Apache License, Version 2", "This is licensed under the GNU General Public License, version 3", "released under the license"):
        best = max(cosine(scanner, text, t) for _, t in L.TEMPLATES)
        got = scanner.score(L.terms(text))
        assert (got is None and best < scanner.least) or got[0] == pytest.approx(best)


def test_place_case_and_runs(scanner):
    text = f"é {PLAIN[0]}\n{MIT.upper()}\nx"
    name, _, a, b = scanner.find(text)
    assert name == "MIT" and text[a:b] == MIT.upper()
    two = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files, to deal in the Software without restriction"
    assert scanner.find(two)[0] == "MIT"
    assert scanner.find("We licensed the design and the public liked it.") is None and scanner.find("") is None


def tree(spark):
    rows = [
        ("a/LICENSE", MIT), ("a/x.txt", PLAIN[0]), ("a/b/y.txt", PLAIN[1]), ("a/b/c/LICENCE.md", f"intro\n{APACHE}"), ("a/b/c/z.txt", PLAIN[2]),
        ("a/b/c/d/e/deep.txt", None), ("a/b/c/own.txt", f"{PLAIN[0]}\n{MIT}"), ("b/README", APACHE), ("b/x.txt", PLAIN[0]), ("top.txt", PLAIN[1]),
        (None, PLAIN[0]), (None, MIT), ("a/x.txt", PLAIN[0]), ("ab/x.txt", ""), ("n/COPYING", PLAIN[0]), ("n/x.txt", PLAIN[0]),
    ] + [("hot/dir/f.txt", PLAIN[i % 3]) for i in range(60)] + [("hot/license", APACHE), ("hot/COPYING", MIT)]
    return spark.createDataFrame([(i, p, t, i) for i, (p, t) in enumerate(rows)], "id long, path string, text string, licence long"), rows


def test_inheritance_against_brute_force(spark, rows):
    files, plain = tree(spark)
    got = {r["id"]: r for r in L.scan_licences(files).collect()}
    n, counts = L.term_counts(files, {t for _, x in L.TEMPLATES for t in L.terms(x)}, "text")
    scanner = L.Scanner(n, counts)
    assert n == len(plain) == len(got)
    own = [scanner.find(t) if t else None for _, t in plain]
    given = {}
    for (path, _), found in zip(plain, own, strict=True):
        if path and found and path.split("/")[-1].split(".")[0].lower() in ("license", "licence", "copying"):
            at = path.rpartition("/")[0]
            given[at] = min(given.get(at, (9, "")), (-found[1], found[0]))
    for i, (path, _) in enumerate(plain):
        parts, near = (path.split("/")[:-1] if path else []), None
        for k in range(len(parts), -1, -1):
            if path and "/".join(parts[:k]) in given:
                near = "/".join(parts[:k])
                break
        assert got[i]["own_licence"] == (own[i][0] if own[i] else None)
        assert got[i]["licence"] == (own[i][0] if own[i] else given[near][1] if near is not None else None)
        assert got[i]["inherited_from"] == (None if own[i] else near)
    assert got[5]["licence"] == "Apache-2.0" and got[2]["licence"] == "MIT" and got[8]["licence"] is None


def test_empty_table(spark):
    assert L.scan_licences(tree(spark)[0].limit(0)).collect() == []


@pytest.mark.parametrize("files", [100, 10_000, 10_000_000])
def test_words_beside_a_notice_and_table_size_do_not_decide(files):
    share = {"the": 0.9, "under": 0.3, "released": 0.02, "licensed": 0.02, "license": 0.03, "version": 0.05, "is": 0.7, "this": 0.5}
    scanner = L.Scanner(files, {t: int(x * files) for t, x in share.items()})
    for text, name, notice in (("Acme is released under the MIT License.", "MIT", "released under the MIT License."),
                               ("Tomcat is licensed under the Apache License, Version 2.0.", "Apache-2.0", "licensed under the Apache License, Version 2.0.")):
        got = scanner.find(text)
        assert got[:2] == (name, pytest.approx(1.0)) and text[got[2]:got[3]] == notice


def test_best_span_against_all_spans(scanner):
    rng = random.Random(4)
    pool = [*L.terms(APACHE + MIT), "acme", "house", "tree", "gnu", "public", "general", "this", "work", "is"]
    found = 0
    for _ in range(60):
        words = rng.choices(pool, k=rng.randint(1, 14))
        if rng.random() < 0.7:
            notice = L.terms(rng.choice([APACHE, MIT]))
            notice.insert(rng.randint(0, len(notice)), rng.choice(pool))
            words[3:3] = notice
        scores = [cosine(scanner, " ".join(words[i:j]), t) for _, t in L.TEMPLATES for i in range(len(words))
                  for j in range(i + 1, min(len(words), i + 2 * len(L.terms(t))) + 1)]
        got = scanner.find(" ".join(words))
        assert (got is None and max(scores) < scanner.least) or got[1] == pytest.approx(max(scores))
        found += got is not None
    assert found > 10


def test_terms_of_no_template_are_counted(spark):
    """A word inside a notice weighs by the files that hold it."""
    odd = "Released under the zebra MIT License."
    files = [(odd,)] + [("the zebra under the tree",)] * 60 + [("the river under the house",)] * 60
    table = spark.createDataFrame([(f"d/{i}", t) for i, (t,) in enumerate(files)], "path string, text string")
    counts = {r["term"]: r["n"] for r in L.frequencies(table, "text").collect()}
    assert (counts[""], counts["zebra"], counts["the"]) == (121, 61, 121)
    got = L.scan_licences(table).where("path = 'd/0'").first()
    scanner = L.Scanner(121, {t: n for t, n in counts.items() if t})
    assert got["own_licence"] == "MIT" and got["own_score"] == pytest.approx(cosine(scanner, odd, MIT), abs=1e-9)
