import math
import random
import re
import textwrap

from trawlnet.llm import licenses as lic


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, threshold=lic.THRESHOLD):
    w = words(text)
    at = [(i, label) for p, label in lic.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    more, score = set(), 0.0
    for line in (text or "").split("\n"):
        block = set(words(line))
        for label, t in lic.TEMPLATES:
            t = set(t.split())
            if len(block & t) >= math.ceil(threshold * len(t) - 1e-9):
                more.add(label)
                score = max(score, len(block & t) / len(t))
    base = {x for _, x in at}
    first, last = (min(i for i, _ in at), max(i for i, _ in at)) if at else (None, None)
    return len(w), len(at), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), round(score, 9)


def got(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)


def test_matches_brute_force(spark):
    rnd = random.Random(8)
    texts = [
        None, "", "\n", "MIT License mit-license, the MIT\nlicense", "General\x7fPublic LICENSE", "GNU general public licence",
        "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0. x y", "MİT License", "KMIT License 1",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following are met",
        "mit license " * 5000,
    ]
    pool = [t for _, t in lic.TEMPLATES]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            t = rnd.choice(pool).split()
            for _ in range(rnd.randrange(4)):
                t.pop(rnd.randrange(len(t)))
            rnd.shuffle(t)
            parts.append(" ".join(x.title() if rnd.random() < 0.3 else x for x in t) + rnd.choice([".", "\n", " über ", "\n\n"]))
        texts.append("".join(parts))
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[6], (None, "mit license", "y")], "doc_id long, text string, label string")
    out = lic.scan(df).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        text = "mit license" if r.doc_id is None else texts[r.doc_id]
        assert got(r) == brute(text), text
    assert lic.scan(df.limit(0)).count() == 0
    plan = lic.scan(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    assert {r.doc_id: got(r) for r in lic.scan(docs).collect()} == want


def in_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def brute_windows(text, threshold=lic.THRESHOLD):
    paragraphs, best = [[]], {}
    for line in text.split("\n"):
        if words(line):
            paragraphs[-1] += words(line)
        else:
            paragraphs.append([])
    for label, t in lic.TEMPLATES:
        own, width = set(t.split()), math.ceil(len(t.split()) / threshold - 1e-9)
        windows = [w[i : i + width] for w in paragraphs for i in range(max(1, len(w) - width + 1))]
        windows = [x for x in windows if len(own & set(x)) >= threshold * len(own) - 1e-9]
        n = max((len(own & set(x)) for x in windows if in_order(x, t.split()) >= threshold * len(t.split()) - 1e-9), default=0)
        if n >= math.ceil(threshold * len(own) - 1e-9):
            best[label] = max(best.get(label, 0), n / len(own))
    return best


def test_texts_wrapped_over_lines(spark):
    rnd, texts = random.Random(5), []
    for label, t in lic.TEMPLATES:
        for prefix in ("", " * ", "# ", "// ", "dnl "):
            long = "Copyright 2020 by the authors of some other work, all of them. " + t + ". More words follow here and there."
            texts.append((label, "int x;\n" + "\n".join(prefix + x for x in textwrap.wrap(long, 72 - len(prefix))) + "\n\nint y;"))
            texts.append((label, "\n".join(prefix + x for x in textwrap.wrap(t, 24))))
    pool = [w for _, t in lic.TEMPLATES for w in t.split()]
    for _ in range(60):
        t = rnd.choice(lic.TEMPLATES)[1].split()
        for _ in range(rnd.randrange(5)):
            t[rnd.randrange(len(t))] = rnd.choice(pool)
        texts.append((None, "\n".join(" ".join(t[i : i + 3]) for i in range(0, len(t), 3)) + rnd.choice(["\n", "\n * \n"]) + " ".join(rnd.choices(pool, k=9))))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in lic.scan(df).collect()}
    found = 0
    for i, (label, text) in enumerate(texts):
        windows, by_line = brute_windows(text), brute(text)
        labels = {x for x in by_line[5].split(",") if x} | set(windows)
        assert set(filter(None, out[i].labels.split(","))) == labels, text
        assert round(out[i].score, 9) == max([by_line[6], *[round(x, 9) for x in windows.values()]]), text
        assert label is None or label in labels or text.startswith("dnl"), text
        found += bool(windows)
    assert found > len(lic.TEMPLATES) * 8
