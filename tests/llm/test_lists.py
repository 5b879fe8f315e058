"""Licence scans and dated url lists against plain versions."""

import random

from pyspark.sql import functions as F

from landgrid.llm import licences, url_lists

MIT = licences.TEMPLATES[4][1]


def dice(a, b):
    x, y = (set(zip(w, w[1:])) for w in (licences.template_words(a), licences.template_words(b)))
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0


def plain_licences(text):
    lines = (text or "").split("\n")
    blocks = [p for p in __import__("re").split(r"\n[ \t]*\n", text or "") if "\n" in p]
    out = set()
    for k, unit in enumerate(lines + blocks):
        for name in {n for n, _ in licences.TEMPLATES}:
            best = max(dice(unit, t) for n, t in licences.TEMPLATES if n == name)
            if 100 * best >= licences.LEAST:
                out.add((name, k, round(best, 9)))
    return sorted(out, key=lambda x: (x[1], x[0]))


def test_licences(spark):
    rng = random.Random(1)
    words = MIT.split(" ")
    texts = [None, "", "x", "one line\nReleased under the MIT License.\nmore", "LICENSED under the   Apache License, version 2.0", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.",
             "intro\n\n" + "\n".join(" ".join(words[k : k + 8]) for k in range(0, len(words), 8)) + "\n \nend", "word " * 20000, "a b " * 3, "Licensed under CC BY-SA 4.0.", "das ist für é"]
    for edits in (1, 3, 6, 12, 25):
        own = list(words)
        for _ in range(edits):
            own[rng.randrange(len(own))] = "other"
        texts.append(" ".join(own))
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_licences", F.lit(1))
    found = licences.licence_units(docs, ["doc_id", "text"]).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [(e.licence, e.unit, round(e.dice, 9)) for e in r._licences] == plain_licences(r.text), r.doc_id
    assert sum(bool(r._licences) for r in found) >= 8
    assert licences.licence_units(docs.where("false"), ["doc_id"]).count() == 0


def test_confusable_and_inline_licences(spark):
    by_text = {t: n for n, t in licences.TEMPLATES}
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice("kan lor mimi tesa vopu".split()) + str(rng.randrange(9)) for _ in range(n))
    gpl3, gpl2 = (next(t for t, n in by_text.items() if n == name and t.startswith("This program")) for name in ("GPL-3.0", "GPL-2.0"))
    by, nc = (next(t for t, n in by_text.items() if n == name and t.startswith("This work")) for name in ("CC-BY-4.0", "CC-BY-NC-4.0"))
    want = [(t, [n]) for t, n in by_text.items()]  # each template alone names its own licence only
    want += [(f"{noise(60)} {t} {noise(90)}", [n]) for t, n in by_text.items()]  # and within a longer line
    want += [(f"{noise(50)} {gpl3} {noise(40)} {gpl2}", ["GPL-2.0", "GPL-3.0"]), (f"{noise(20)} {nc} {noise(20)} {by}", ["CC-BY-4.0", "CC-BY-NC-4.0"])]
    want += [(gpl3.replace("version 3 of", "version of"), ["GPL-2.0", "GPL-3.0"]), (gpl3.replace("version 3 of", "version x 3 y of"), ["GPL-3.0"])]
    want += [(f"{noise(30)}\n{nc[:40]}\n{nc[40:]} {noise(30)}", ["CC-BY-NC-4.0"]), (f"a\n{noise(9)} {by} {noise(9)}\nb", ["CC-BY-4.0"]), (noise(500), [])]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(want)], "doc_id bigint, text string")
    found = {r.doc_id: r._licences for r in licences.licence_units(docs, ["doc_id"]).collect()}
    for k, (text, names) in enumerate(want):
        assert [e.licence for e in found[k]] == names, (text, found[k])


def test_size_bounds_are_exact():
    for size in range(1, 60):
        low, high = licences.size_bounds(size, 80)
        fits = [n for n in range(1, 200) if 200 * min(n, size) >= 80 * (n + size)]
        assert (min(fits), max(fits)) == (low, high)


def test_url_lists(spark):
    rng = random.Random(2)
    patterns, hosts = ["example.com", "a.example.com", "B.example.com", "org", "x.org"], ["a.example.com", "c.a.example.com", "b.example.com", "example.com", "x.org", "notexample.com"]
    entries = [(rng.choice(patterns), rng.choice(["spam", "adult"]), rng.choice(["add", "remove", "Add"]), rng.randrange(0, 4_000_000)) for _ in range(60)]
    entries += [("x.org", "spam", "add", 100), ("x.org", "spam", "remove", 100), (None, "spam", "add", 1), ("x.org", None, "add", 1), ("x.org", "spam", "add", None), entries[0]]
    captures = [(k, f"https://u:p@{rng.choice(hosts)}:80/p?q=http://example.com/", rng.randrange(0, 4_000_000)) for k in range(300)]
    captures += [(900, None, 5), (901, "no url", 5), (902, "http://A.Example.COM./", 3_999_999), (903, "http://a.example.com", None), captures[0]]
    frame = spark.createDataFrame(captures, "page_id bigint, url string, fetched_at bigint").withColumns({"row": F.lit("r"), "pattern": F.lit("p"), "host": F.lit("h")})
    listing = spark.createDataFrame(entries, "pattern string, category string, action string, at bigint")
    found = url_lists.listed(frame, listing, bucket=100_000).collect()
    assert len(found) == len(captures) and all((r.row, r.pattern, r.host) == ("r", "p", "h") for r in found)

    known = sorted({(p.lower(), c, a.lower(), t) for p, c, a, t in entries if None not in (p, c, a, t)}, key=lambda e: (e[0], e[1], e[3], e[2]))
    spans = []
    for k, (p, c, a, t) in enumerate(known):
        after = known[k + 1] if k + 1 < len(known) and known[k + 1][:2] == (p, c) else None
        if a == "add" and (after is None or after[3] > t):
            spans.append((p, c, t, after[3] if after else None))
    by = {r.page_id: r._listed for r in found}
    for i, url, at in captures:
        own = by[i]
        host = None if url in (None, "no url") else url.split("//")[1].split("/")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
        active = [s for s in spans if host and at is not None and (host == s[0] or host.endswith("." + s[0])) and s[2] <= at and (s[3] is None or at < s[3])]
        best = min(active, key=lambda s: (-len(s[0]), -s[2], s[1])) if active else (None, None, None)
        assert (own.host, own.n_active, own.pattern, own.category, own.valid_from) == (host, len(active), *best[:3])
    assert sum(r.n_active > 1 for r in by.values()) > 20
    assert url_lists.listed(frame.where("false"), listing).count() == 0
    assert {r._listed.n_active for r in url_lists.listed(frame, listing.where("false")).collect()} == {0}
