import random
import re
import time

from strandline.llm.license_scan import BASE, Rule, Scanner, resolve, rules, scan_licenses


def base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), sorted((label, i) for phrase, label in BASE for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p)


def test_base_places(spark):
    rng = random.Random(6)
    parts = ["CC", "by", "CC-BY", "general", "Public", "license", "all rights reserved", "é", "x", "\n", ".", "licenses", "cc by cc by"]
    texts = [None, "", "cc", "all rights reserved."] + [" ".join(rng.choices(parts, k=rng.randrange(0, 30))) for _ in range(300)] + ["x " * 50_000 + "cc by"]
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(0, None, "")]
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect():
        assert (r["n_words"], sorted((b["label"], b["place"]) for b in r["base"])) == base(texts[r["doc_id"]])
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def labels(text):
    s = Scanner(rules())
    return [r.label for _, _, r in s.scan(s.words(text)[0])[0]]


def test_signatures():
    assert len(rules()) >= 200 and len({(r.pattern, r.label) for r in rules()}) == len(rules())
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("Released under the MIT License.") == ["mit"]
    assert labels("GPL v2 or any later version") == ["gpl-2.0-or-later"]
    assert labels("a mitigated apachean text, plain and without anything") == []


def test_containment_and_priority():
    a, b, c = (Rule(x, "k", "k", p, 1.0) for x, p in (("a", 10), ("b", 20), ("c", 20)))
    assert resolve([(0, 5, a), (0, 5, b)]) == [(0, 5, b)]
    assert resolve([(0, 5, b), (2, 3, c)]) == [(0, 5, b)]
    assert resolve([(0, 3, b), (3, 6, a)]) == [(0, 3, b)]
    assert resolve([(0, 2, b), (3, 6, a)]) == [(0, 2, b), (3, 6, a)]


def strings(parsed):
    """Strings that a parsed pattern matches: all branches, repeats at their least number and one more, one character a class."""
    out = [""]
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(arg)]
        elif op == "IN":
            some = [{"CATEGORY_DIGIT": "0", "CATEGORY_NOT_SPACE": "x"}[str(x)] if str(kind) == "CATEGORY" else chr(x) for kind, x in arg]
        elif op == "BRANCH":
            some = [x for branch in arg[1] for x in strings(branch)]
        elif op == "SUBPATTERN":
            some = strings(arg[-1])
        else:
            assert op == "MAX_REPEAT", op
            least, most, sub = arg
            once = strings(sub)
            some = [""]
            for _ in range(least):
                some = [a + b for a in some for b in once]
            some += [a + b for a in some for b in once] if most > least else []
        out = [a + b for a in out for b in some]
    return out


def test_what_a_rule_matches_holds_its_keyword():
    lost = set()
    for rule in rules():
        found = strings(re._parser.parse(rule.pattern))
        assert found and all(re.fullmatch(rule.pattern, x) for x in found[:: len(found) // 50 + 1])
        lost |= {(rule.keyword, rule.pattern) for x in found if rule.keyword not in x}
    assert not lost


def test_names_without_the_familys_keyword():
    assert labels("Released under the Expat License") == ["mit"]
    assert labels("Internet Systems Consortium license") == ["isc"]
    assert labels("Unauthorised copying is strictly prohibited") == labels("Unauthorized copying is strictly prohibited") == ["proprietary"]


def test_versions_in_identifiers_win():
    assert labels("SPDX-License-Identifier: GPL-3.0-only") == ["gpl-3.0"]
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0-or-later"]
    assert labels("SPDX-License-Identifier: Apache-2.0") == ["apache-2.0"]
    assert labels("SPDX-License-Identifier: MIT") == ["mit"]
    assert labels("SPDX-License-Identifier: MIT OR Apache-2.0") == ["mit", "apache-2.0"]
    assert labels("SPDX-License-Identifier: LGPL-2.1") == ["lgpl-2.1"]


def quadratic(hits):
    kept = []
    for a, b, rule in sorted(hits, key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].label)):
        if not any((x <= a and b <= y) or (x <= b and a <= y and r.priority > rule.priority) for x, y, r in kept):
            kept.append((a, b, rule))
    return sorted(kept, key=lambda h: (h[0], h[1], h[2].label))


def test_resolve_against_all_pairs():
    rng = random.Random(5)
    for n in (0, 1, 5, 30, 200):
        for _ in range(60):
            hits = []
            for _ in range(n):
                a = rng.randrange(40 + n)
                hits.append((a, a + rng.randrange(8), Rule(rng.choice("abc"), "k", "k", rng.choice([10, 20, 30]), 1.0)))
            assert resolve(hits) == quadratic(hits)


def test_many_hits_in_one_text():
    s = Scanner(rules())
    began = time.perf_counter()
    found, _ = s.scan(s.words("licensed under the mit license. gpl v2. see text. " * 20_000)[0])
    assert len(found) == 40_000 and time.perf_counter() - began < 20


def unfiltered(text):
    """Every rule tried on every text, without the automaton and the bisected resolution."""
    plain = Scanner(rules()).words(text)[0]
    hits = []
    for rule in rules():
        for m in re.finditer(rb"(?<= )(?:" + rule.pattern.encode() + rb")(?= )", plain):
            hits.append((plain[: m.start()].count(b" ") - 1, plain[: m.end()].count(b" ") - 1, rule))
    return [(a, b, r.label) for a, b, r in quadratic(hits)]


def test_labels_against_a_scan_without_prefilter(spark):
    texts = [strings(re._parser.parse(r.pattern))[-1] for r in rules()[::9]]
    rng = random.Random(7)
    texts = [" and ".join(rng.sample(texts, 3)) for _ in range(40)] + ["", "nothing to see"]
    found = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(found) == len(texts)
    for r in found:
        assert [(d["first"], d["last"], d["label"]) for d in r["detections"]] == unfiltered(texts[r["doc_id"]]), texts[r["doc_id"]]
