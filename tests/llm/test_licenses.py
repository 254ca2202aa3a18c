import re

from defectlens.llm import licenses
from defectlens.llm.license_rules import LICENSES, PHRASES, SCORES, STEMS, rules, spellings

SCHEMA = "doc_id long, text string, id string, base string, row string, n_words string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text):
    words = WORDS.findall((text or "").translate(LOWER))
    norm, places, base = f" {' '.join(words)} ", [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    spans = []
    for number, r in enumerate(rules()):
        if r.stem in norm and r.keyword in norm:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
                start = norm[: m.start()].count(" ") - 1
                spans.append((start, start + m[0].count(" ") + 1, number, r.tier, r.label))
    kept = []
    for a in spans:
        better = lambda b: (b[:2] != a[:2]) or (b[3], b[2]) < (a[3], a[2])
        if not any(b[0] <= a[0] and a[1] <= b[1] and b[3] <= a[3] and better(b) for b in spans if b is not a):
            kept.append(a)
    labels = sorted(base | {s[4] for s in kept})
    score = SCORES[0] if places else max((SCORES[s[3]] for s in kept), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(kept), labels, score


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)
    got = licenses.scan_licenses(df).collect()
    flat = [(r["id"], r["n_words"], r["base"]["n"], r["base"]["first"], r["base"]["last"], r["base"]["labels"],
             [tuple(d) for d in r["detections"]], r["labels"], r["score"]) for r in got]
    assert sorted(flat, key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_hundreds_of_rules():
    table = rules()
    assert len(table) > 200 and {r.tier for r in table} == {0, 1, 2} and {r.stem for r in table} <= set(STEMS)
    for r in table:
        re.compile(r.pattern)


def test_equals_plain_python(spark):
    texts = [
        "Released under the MIT License.", "under the mit license under the MIT license\nunder the mit-license", "Licensed under the Apache License, Version 2.0 (the License)",
        "Licensed under CC BY-NC 4.0.", "cc by nc cc by nc sa 4.0 cc-by", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: MIT",
        "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1 and GNU General Public License",
        "Distributed under the terms of the 3-Clause BSD License; all rights reserved", "in the public domain", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0",
        "no licence here", "apache license", "apache license version 2x", "théapache license version 2", "under the mit license" * 3, "UNDER\x7fTHE{MIT}LICENSE", "İ under the mit licenſe",
        "available under the Boost Software License 1.0, the zlib License or the Unlicense", "mit", "kcc by nc", None, "", " \n", "...", "License " * 2000,
        "Released under the MIT License.\n" * 300,
    ]
    check(spark, [(i, t) for i, t in enumerate(texts)])


def test_odd_rows(spark):
    check(spark, [(None, "all rights reserved"), (None, "all rights reserved"), (1, "x"), (1, "under the mit license")])
    check(spark, [])


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = licenses.scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("CartesianProduct", "NestedLoop", "Python", "Pandas", "ArrowEval"))


UNGATED = [
    "Licensed under the GPL-3.0-or-later", "released under MPL 2.0", "distributed under EPL-2.0", "licensed under CDDL 1.0 or EUPL-1.2", "available under OSL-3.0",
    "provided under AFL 3.0", "released under BSL-1.0", "covered under SSPL 1.0", "published under ODbL 1.0", "licensed under OFL-1.1", "released under WTFPL",
    "PSF License", "Creative Commons Attribution ShareAlike 4.0", "MIT No Attribution", "SPDX-License-Identifier: PHP-3.01", "SPDX-License-Identifier: PHP-3.0",
    "released under cc by 4.0", "released under the MIT", "released under the MIT license",
]


def test_no_gate_hides_a_match(spark, monkeypatch):
    monkeypatch.setitem(globals(), "rules", lambda real=rules: [r._replace(stem="", keyword="") for r in real()])
    check(spark, [(i, t) for i, t in enumerate(UNGATED)])
    assert all(brute(t)[6] for t in UNGATED)


def test_every_spelling_of_a_rule_passes_its_gates():
    for line in LICENSES.strip().splitlines():
        label, _, identifier, name = (part.strip() for part in line.split(" | "))
        texts = [f" spdx license identifier {i} " for i in spellings(identifier)]
        texts += [f" licensed under {n} " for n in spellings(identifier) | spellings(name)] + [f" {n} " for n in spellings(name)]
        for r in (r for r in rules() if r.label == label):
            for t in texts:
                assert not re.search(f"(?<= )(?:{r.pattern})(?= )", t) or (r.stem in t and r.keyword in t), (r, t)
