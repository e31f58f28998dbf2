import random
import time
from collections import Counter

import pytest

from flowmill.llm import licences
from flowmill.llm.common import table
from flowmill.llm.licence_texts import MIT, TEMPLATES

SF = "/root/testdata/sf0.001"


def brute(text, templates, threshold=licences.THRESHOLD):
    """licence -> (coefficient, first line), over every run of lines; runs that overlap a better one don't count."""
    lines = list(licences.lines_of(text or ""))
    found = []
    for k, (_, template) in enumerate(templates):
        flat = [w for line in licences.lines_of(template) for w in line]
        b = Counter(zip(flat, flat[1:]))
        for i in range(len(lines)):
            own, best = [], None
            for j in range(i, len(lines)):
                own += lines[j]
                a = Counter(zip(own, own[1:]))
                if not a or not b:
                    continue
                dice = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
                if dice >= threshold - 1e-12 and (best is None or dice > best[0]):
                    best = (dice, j + 1)
            if best:
                found.append((-best[0], k, i, best[1]))
    kept, out = [], {}
    for dice, k, i, j in sorted(found):
        if all(j <= x or i >= y for x, y in kept):
            kept.append((i, j))
            name = templates[k][0]
            out[name] = max(out.get(name, (0, 0)), (-dice, -i))
    return {n: (d, -line) for n, (d, line) in out.items()}


TEXTS = [
    MIT, "Copyright (c) 2020 Someone\n\n" + MIT.replace("sell", "sells") + "\nint main() {}\n", "code\nSPDX-License-Identifier: MIT\nmore code", "Released under the MIT License.\nAnd again\nReleased under the MIT License",
    "All rights reserved. All rights reserved.", "nothing here of the kind", "", None, "\n\n", "license", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY 4.0", " ".join(MIT.split()).upper(), "\n".join(MIT.split(" ")[:80]),
]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_scan_equals_brute_force(spark, k):
    got = {r["licence"]: (r["dice"], r["line"]) for r in licences.scan_licences(spark.createDataFrame([(k, TEXTS[k], 1)], "doc_id int, text string, line int")).collect()}
    want = brute(TEXTS[k], TEMPLATES)
    assert got.keys() == want.keys()
    assert all(got[n] == pytest.approx(want[n]) for n in want)


def test_documents_against_brute_force(spark):
    docs = table(spark, SF, "documents").where("length(text) < 3000")
    got = {(r["doc_id"], r["licence"]): r["dice"] for r in licences.scan_licences(docs).collect()}
    few = [t for t in TEMPLATES if len(t[1]) < 100]
    rows = [r for r in docs.collect() if any(w in r["text"].lower() for w in ("licen", "rights"))]
    want = {(r["doc_id"], n): d for r in rows for n, (d, _) in brute(r["text"], few).items()}
    assert got == pytest.approx(want) and got


def test_sister_licences_in_one_text(spark):
    named = dict(TEMPLATES)
    gnu = [n for n in named if n.upper().startswith(("AGPL", "GPL"))][:2]
    text = named[gnu[0]] + "\n\nsome lines of code\n" + named[gnu[1]].replace("useful", "of use") + "\n"
    got = {r["licence"] for r in licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    assert set(gnu) <= got
    assert got == brute(text, TEMPLATES).keys()


def test_long_texts_of_licence_words():
    words = [w for _, t in TEMPLATES for line in licences.lines_of(t) for w in line]
    rng = random.Random(3)
    text = "\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(8000)) + "\n" + MIT
    own = licences.Templates(TEMPLATES, licences.THRESHOLD)
    began = time.process_time()
    found = own.scan(text)
    assert len(text) > 400_000 and time.process_time() - began < 1
    assert "MIT" in {own.names[k] for k, _, _ in found}


def test_templates_of_a_folder(spark, tmp_path):
    (tmp_path / "Mine-1.0.txt").write_text("you may do as you like with this text\nas long as you keep it whole")
    given = licences.read_templates(spark, str(tmp_path))
    assert [n for n, _ in given] == ["Mine-1.0"]
    docs = spark.createDataFrame([(1, "x\nYou may do as you like with this text\nas long as you keep it whole!\ny")], "doc_id int, text string")
    assert [(r["licence"], r["dice"]) for r in licences.scan_licences(docs, given).collect()] == [("Mine-1.0", 1.0)]


def test_edges(spark, edges):
    assert licences.scan_licences(edges).count() == 0
    assert licences.scan_licences(edges.limit(0)).count() == 0
    assert licences.scan_licences(edges, []).count() == 0
    twice = edges.where("doc_id = 4").selectExpr("doc_id", "'All rights reserved' text").unionAll(edges.where("doc_id = 4").selectExpr("doc_id", "'All rights reserved' text"))
    assert licences.scan_licences(twice).count() == 2
