import random

from quarrylens.llm.licences import TEMPLATES, common, license_spans


def brute(text, template, cover=0.8):
    """Whether any window of a text holds a template, by common subsequences."""
    import re

    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    t = re.findall(r"[a-z0-9\x80-\U0010ffff]+", template.lower())
    return any(common(t, w[i : i + len(t) + 6]) / len(t) >= cover for i in range(len(w)))


def filler(rng, n):
    return " ".join(f"w{rng.randrange(900)}" for _ in range(n))


def test_planted_licences_whole_and_changed(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i, (name, text) in enumerate(sorted(TEMPLATES.items())):
        words = text.split()
        if len(words) > 20:  # one word changed, one left out, one put in
            words[7] = "changed"
            del words[12]
            words.insert(16, "extra")
        rows.append((i, f"{filler(rng, 40)} {' '.join(words)} {filler(rng, 30)}"))
        want[i] = name
    rows += [(100 + i, filler(rng, 120)) for i in range(20)]
    got = {}
    for r in license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    # a long text that holds a shorter template's words may be read as either; the longest stays
    assert set(got) == set(want) and all(want[i] in {r["license"] for r in rs} or max(len(TEMPLATES[r["license"]]) for r in rs) >= len(TEMPLATES[want[i]]) for i, rs in got.items())
    assert all(abs(min(r["first_word"] for r in rs) - 40) <= 8 for rs in got.values())


def test_common_subsequence_against_the_table():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
        assert common(a, b) == row[-1]


def test_documents_against_brute_force(spark, sf):
    """Whole texts, short templates, both ways and by name: a document has a hit if and only if a window of it holds a template."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    short = {k: v for k, v in TEMPLATES.items() if len(v.split()) < 12}
    got = {}
    for r in license_spans(docs, short).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    words = {w for v in short.values() for w in v.lower().replace(".", " ").replace(",", " ").split()}
    for r in docs.collect():
        likely = len(words & set(r["text"].lower().replace(".", " ").replace(",", " ").split())) > 2
        held = {k for k, v in short.items() if brute(r["text"], v)} if likely else set()
        assert bool(held) == bool(got.get(r["doc_id"])) and got.get(r["doc_id"], set()) <= held
    assert got


def test_short_notices_with_a_word_changed(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i, (name, text) in enumerate((k, v) for k, v in sorted(TEMPLATES.items()) if 5 <= len(v.split()) <= 9):
        for at in range(1, len(text.split()) - 1):
            w = text.split()
            w[at] = "changed"
            rows.append((100 * i + at, f"{filler(rng, 20)} {' '.join(w)} {filler(rng, 20)}"))
            want[100 * i + at] = text
    got = {r["doc_id"] for r in license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [i for i, text in rows if i not in got and brute(text, want[i])]
    assert not missed and len(got) > 20


def test_hits_that_do_not_overlap_the_best_stay(spark):
    text = f"{TEMPLATES['mit']} {TEMPLATES['mit-warranty']} some words between {TEMPLATES['cc-by-4.0-notice']} and {TEMPLATES['apache-2.0-header']}"
    out = license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {r["license"] for r in out} >= {"mit", "mit-warranty", "cc-by-4.0-notice", "apache-2.0-header"}
    spans = sorted((r["first_word"], r["last_word"]) for r in out)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_odd_rows(spark, odd, none):
    assert license_spans(odd).count() == 0 and license_spans(none).count() == 0
    text = TEMPLATES["mit-notice"]
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, text, "a"), (2, None, "a"), (3, "", "a"), (4, "x " * 50_000 + text, "a")], "doc_id long, text string, license string")
    out = {r["doc_id"]: r["first_word"] for r in license_spans(docs).collect()}
    assert set(out) == {1, None, 4} and out[4] == 50_000
