"""Toxicity scores against a plain convolution, and licence labels against a search of every rule in every text."""

import random
import re

import numpy as np

from storyproof.llm import licenses, toxicity
from storyproof.llm.license_rules import rules

r = random.Random(3)


def plain_score(model, text):
    """One place, filter and width after the other."""
    words, _ = toxicity.features([text])
    z, at, f = model.out_bias, 0, toxicity.FILTERS
    for k, width in enumerate(toxicity.WIDTHS):
        for j in range(f):
            best = 0.0
            for p in range(len(words) - width + 1):
                total = float(model.bias[k * f + j])
                for i in range(width):
                    total += float(sum(model.table[b, at + i * f + j] for b in words[p + i]))
                best = max(best, total)
            z += best * float(model.out[k * f + j])
        at += width * f
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_scores_against_a_plain_convolution():
    good, bad = ["fine day", "nice old house", "walk by the sea"], ["you vile fool", "awful wretch you are", "hate hate hate"]
    texts = [(" ".join(r.choices(bad if k % 2 else good, k=3)), k % 2) for k in range(80)]
    model = toxicity.fit([t.encode() for t, _ in texts], [y for _, y in texts], 0.3, epochs=2)
    asked = [b"", b"fool", b"you vile", "vile Ünï 日本 wretch".encode(), *(t.encode() for t, _ in texts[:20]), b"a b c d e f g", b"...", b"hate " * 50]
    got = model.score(asked)
    assert np.allclose(got, [plain_score(model, t) for t in asked], atol=1e-5)
    assert np.allclose(got, [model.score([t])[0] for t in asked], atol=1e-6)  # whatever stands beside a text


def plain_detections(text):
    """What every rule finds alone, without what lies inside something of the same or a higher priority."""
    words = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line = " " + " ".join(words) + " "
    found = []
    for rule in rules():
        at = 0
        pattern = re.compile(f"(?<= )(?:{rule['pattern']})(?= )")
        while m := pattern.search(line, at):
            start = line[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, rule["rule"], rule["priority"], rule["label"]))
            at = max(m.end(), at + 1)
    holds = lambda a, b: a[0] <= b[0] and b[1] <= a[1] and a[3] >= b[3] and (a[:2] != b[:2] or a[3] > b[3] or a[2] < b[2])
    return sorted((b[0], b[1], b[4]) for b in found if not any(holds(a, b) for a in found if a is not b))


def test_all_rules_against_a_plain_search(spark):
    pieces = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??|licen\[cs\]e", lambda m: m[1] if m[1] else "license", p["pattern"].split("|")[0]) for p in rules()]
    pieces = [re.sub(r"[^a-z0-9 ]", "", p) for p in pieces] + ["MIT License", "GNU General Public License version 3", "or any later version", "Apache License, Version 2.0", "CC-BY 4.0", "plain words", "x"]
    texts = [" ".join(r.choices(pieces, k=r.randrange(1, 9))) for _ in range(150)] + [None, "", "The MIT license. " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: sorted((m["start"], m["end"], m["label"]) for m in x["found"]) for x in licenses.scan(df).select("doc_id", "found").collect()}
    want = {i: plain_detections(t) for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 300
