import math
import re
import textwrap
from collections import Counter

from rankloom.llm import licenses

MODEL = licenses.Model()
MIT, GPL = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 99), next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and len(t) > 99)
CC = "Licensed under CC BY-NC 4.0."


def notices(path, text):
    """Best cosine of the nearest licence of each passage, and whether the file is named like a licence."""
    named = re.match(r"(?i)(licen[sc]e|copying|notice)([._-].*)?$", path.rpartition("/")[2])
    lines = [re.sub(licenses.CLOSING, "", re.sub(licenses.OPENING, "", x, count=1), count=1) for x in text.split("\n")]
    best = {}

    def nearest(units):
        found = []
        for unit in units:
            x = {t: n * MODEL.idf.get(t, MODEL.unknown) for t, n in Counter(licenses.terms_of(unit)).items()}
            norm = math.sqrt(sum(v * v for v in x.values()))
            scores = Counter()
            for number, name, t, w in MODEL.rows:
                scores[-number, name] += x.get(t, 0) * w / norm if norm else 0
            rounded, (number, name) = max((round(v, 9), k) for k, v in scores.items())
            if scores[number, name] >= licenses.LEAST:
                found.append((name, scores[number, name]))
        return found

    for p in "\n".join(lines).split("\n\n"):
        for name, score in nearest([p]) or nearest(re.sub(licenses.SENTENCE, ".\x01\\1", p).split("\x01")) or nearest(p.split("\n")):
            best[name] = max(score, best.get(name, 0))
    for name, score in nearest([text]) if named else ():
        best[name] = max(score, best.get(name, 0))
    return best, bool(named)


def shown(names):
    return ",".join(sorted(n for n in names if n != "BSD" or not any(x.startswith("BSD-") for x in names)))


def plain(files):
    own, held = {}, {}
    for path, text in files:
        if path is None or text is None:
            continue
        best, named = notices(path, text)
        own.setdefault(path, {}).update({k: max(v, own.get(path, {}).get(k, 0)) for k, v in best.items()})
        if named and best:
            held.setdefault(path.rpartition("/")[0], set()).update(best)
    out = []
    for path, _ in files:
        mine = own.get(path) or {}
        above = path.rpartition("/")[0] if path is not None else None
        while above is not None and above not in held:
            above = None if above == "" else above.rpartition("/")[0]
        inherited = "" if mine or above is None else shown(held[above])
        names = shown(mine)
        out.append((path, names, round(max(mine.values(), default=0.0), 4), inherited, names or inherited))
    return sorted(out, key=str)


def check(spark, files):
    df = spark.createDataFrame([(*f, "clash", 1.0) for f in files], "path string, text string, license string, score double")
    got = licenses.scan(df).collect()
    assert sorted(((r.path, r.own, r.score, r.inherited, r.license) for r in got), key=str) == plain(files)


def test_notices_and_inheritance(spark):
    check(spark, [
        ("LICENSE", MIT), ("a/x.py", "print(1)"), ("a/b/COPYING", "Preamble\n\n" + GPL.replace(" as ", "\nas ") + "\n\nend"), ("a/b/c/d/y.py", "code"), ("a/b/z.py", "# " + CC),
        ("ab/w.py", "code\n" + MIT + "\n" + GPL), ("a/LICENSE.txt", "no licence in here"), ("/rooted/q.py", "x"), ("a/b/notice", MIT + "\n" + MIT), ("a/b/notice", None)])


def test_edges(spark):
    files = [(None, MIT), ("p", None), ("p", ""), ("p", MIT), ("p", MIT), ("q/r", "word " * 100_000 + "\n" + MIT), ("", "x")]
    check(spark, files)
    check(spark, [("d/LICENSE", "MIT")])
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).isEmpty()


def test_neighbours_are_told_apart(spark):
    """Every template alone, wrapped in a comment with text around it, and the forms that were once misread."""
    def wrapped(text):
        return "# Title of the file\n#\n" + "\n".join("# " + x for x in textwrap.wrap(text, 60, break_on_hyphens=False)) + "\n#\n\ncode = 1"

    rows = [(f"{i}/a", name, text) for i, (name, text) in enumerate(licenses.TEMPLATES)] + [(f"{i}/b", name, wrapped(text)) for i, (name, text) in enumerate(licenses.TEMPLATES)]
    gpl2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    rows += [("x/1", "GPL-2.0", gpl2), ("x/2", "GPL-2.0", "This work is licensed under the GNU GPL, version 2.".replace("GNU GPL", "GNU General Public License")), ("x/3", "CC-BY-NC-4.0", CC + " See LICENSE for details."), ("x/4", "MIT", "Licensed under the MIT license."), ("x/5", "", "permission to use the software")]
    found = {r.path: r.own for r in licenses.scan(spark.createDataFrame([(p, t) for p, _, t in rows], "path string, text string")).collect()}
    wrong = {p: (name, found[p]) for p, name, _ in rows if name not in found[p].split(",") or (name != "BSD-3-Clause" and name != "BSD-2-Clause" and found[p] != name)}
    assert not wrong


def test_very_long_terms_and_lines(spark):
    """A matcher that recurses on repeated groups ended the JVM here."""
    files = [("a", "a." * 5_000_000 + "\n" + MIT), ("b", "x" * 10_000_000 + " license"), ("c", "-" * 1_000_000 + "\n" + "# " * 500_000)]
    found = {r.path: r.own for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert found == {"a": "MIT", "b": "", "c": ""}
