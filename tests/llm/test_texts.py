from __future__ import annotations

import pickle
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirelake.llm import leakage, packing, subjects
from wirelake.session import kept

# --- packing


def check_bins(sizes, bins, capacity):
    fill = np.bincount(bins, weights=sizes)
    assert len(bins) == len(sizes) and (fill > 0).all() and (fill <= capacity).all()
    return len(fill)


@pytest.mark.parametrize("seed", range(6))
def test_pack_is_valid_and_close_to_the_bound(seed):
    rnd = np.random.default_rng(seed)
    sizes = rnd.integers(1, 101, 300) if seed % 2 else np.minimum(100, rnd.lognormal(3, 1, 300).astype(int) + 1)
    n = check_bins(sizes, packing.pack(sizes, 100), 100)
    assert n <= -(-sizes.sum() // 100) * 1.08 + 1


def test_local_search_empties_bins_that_greedy_packing_leaves():
    # largest first puts 6 with 4 twice over; exchanges find 6+2+2 and 4+3+3
    sizes = np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6])
    greedy = packing.pack(sizes, 60, search=False)
    better = packing.pack(sizes, 60)
    assert check_bins(sizes, better, 60) == 3 and check_bins(sizes, greedy, 60) >= 3
    worse = 0
    for seed in range(200):
        rnd = np.random.default_rng(seed)
        s = rnd.integers(10, 60, 40)
        a, b = check_bins(s, packing.pack(s, 100, False), 100), check_bins(s, packing.pack(s, 100), 100)
        assert b <= a
        worse += b < a
    assert worse > 0
    assert packing.pack(np.empty(0, np.int64), 10).size == 0 and check_bins(np.array([10, 10]), packing.pack(np.array([10, 10]), 10), 10) == 2


def test_containers(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(("alpha", "beta", "x=1;")) for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "word " * 900), (503, "y" * 5000), (None, "text"), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"container": F.lit(1), "grp": F.lit(2), "row": F.lit(3), "n_tokens": F.lit(4)})
    got = packing.containers(df, capacity=100, group=40).collect()
    enc = packing.encoder(packing.RANKS)
    fill: dict = {}
    per: dict = {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        per.setdefault(r.doc_id, []).append(r)
    assert max(fill.values()) <= 100 and set(per) == {r[0] for r in rows if r[1]}
    for i, t in {r[0]: r[1] for r in rows if r[1]}.items():
        size = len(enc.encode_ordinary(t))
        copies = 2 if i == 7 else 1
        assert sum(r.n_tokens for r in per[i]) == size * copies
        # whole unless it exceeds a container, and then pieces side by side
        assert len(per[i]) == -(-size // 100) * copies
        if copies == 1:
            assert sorted((r.piece, r.token_from) for r in per[i]) == [(k, 100 * k) for k in range(-(-size // 100))]
    assert packing.containers(df.limit(0)).count() == 0
    assert [r.n_tokens for r in packing.token_counts(df.where("doc_id >= 500 AND doc_id < 502")).orderBy("doc_id").collect()] == [0, 0]


# --- leakage

WORDS = [f"w{i}" for i in range(400)]
SHARED = "Read the task with care and write one function that solves it for every input within the limits given here and print nothing else."


def items_and_words(n=12, size=60):
    rnd = random.Random(3)
    bodies = {i: [f"{rnd.choice(WORDS)}{i}" for _ in range(size)] for i in range(n)}
    return {i: (SHARED + "\n\n" if i % 2 else "") + " ".join(w) for i, w in bodies.items()}, bodies


def found_in(text, items):
    cleaned = leakage.bodies(items)
    return {i for i, *_ in leakage.Matcher(cleaned).items_in(text)}


def test_layouts():
    items, w = items_and_words()
    p = w[3][10:40]
    layouts = [
        " ".join(p), " ".join(p).upper(), "\n".join(f"# {' '.join(p[i : i + 6])}" for i in range(0, 30, 6)), "/* " + "\n * ".join(" ".join(p[i : i + 7]) for i in range(0, 30, 7)) + " */",
        'x = "' + "\\n".join(" ".join(p[i : i + 5]) for i in range(0, 30, 5)) + '"', '{"lines": [' + ",\n".join(f'"{" ".join(p[i : i + 8])}"' for i in range(0, 30, 8)) + "]}",
        "<p>" + "&nbsp;".join(p[:15]) + "&#44; <br/>" + " ".join(p[15:]) + "</p>", ",  ".join(p), "\r\n".join(" ".join(p[i : i + 6]) for i in range(0, 30, 6)),
        "\n".join(f"// {' '.join(p[i : i + 7])}\nstep_{i}(value, other, third, fourth, fifth);" for i in range(0, 30, 7)), "".join(f"// {' '.join(p[i : i + 7])} step_{i}(); " for i in range(0, 30, 7)), "%20".join(p), "_".join(p),
        "\\u0020".join(p),
    ]
    for text in layouts:
        assert found_in("before it\n" + text + "\nafter it", items) == {3}, text


def test_length_and_replaced_words():
    items, w = items_and_words()
    assert found_in("other " + " ".join(w[5][7:27]) + " words", items) == {5}
    assert found_in("other " + " ".join(w[5][7:26]) + " words", items) == set()
    for keep, every in ((True, 7), (False, 4)):
        p = [x if (k + 1) % every else "maybe" for k, x in enumerate(w[5][:42])]
        assert (found_in(" ".join(p), items) == {5}) is keep
    assert found_in(" ".join(reversed(w[5])), items) == set()
    assert found_in(SHARED, items) == set() and found_in("", items) == set() and found_in(" ".join(w[1] + w[2]), items) == {1, 2}


def test_turns_of_phrase_that_items_share_are_no_leak():
    turn = "on day {} a {} tile rolls from the attic into the garden whereupon somebody pays {} and another keeps the {} ribbons before dusk"
    items = {i: ". ".join(turn.format(100 * i + k, f"a{i}{k}", 7 * i + k, f"b{i}{k}") for k in range(3)) for i in range(8)}
    assert found_in(turn.format(9999, "new", 8888, "other"), items) == set()
    assert found_in(items[4].split(". ")[1], items) == {4}


def test_offsets_lead_to_the_original(spark):
    items, w = items_and_words()
    text = 'head of it\n"prompt": "' + "\\n".join(" ".join(w[2][k : k + 6]) for k in range(0, 36, 6)) + '",\ntail'
    rows = [(1, text), (2, None), (3, ""), (None, text), (4, "x " * 100_000 + text), (5, text), (5, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(0), "start": F.lit("x")})
    its = spark.createDataFrame([*items.items(), (99, None), (None, items[2]), (98, "too short")], "item_id long, text string").withColumn("doc_id", F.lit(7))
    got = leakage.leaked(docs, its).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.doc_id) == [(1, 2), (4, 2), (5, 2), (5, 2)] and len(got) == 5
    one = next(r for r in got if r.doc_id == 1)
    assert re.findall(r"[^\W_]+", text[one.start : one.end].replace("\\n", " ")) == w[2][:36]
    assert leakage.contaminated(docs, its).count() == 4
    assert {tuple(r) for r in leakage.leaked(docs, its, most_words=100).select("doc_id", "item_id").collect()} == {(r.doc_id, r.item_id) for r in got}
    assert leakage.leaked(docs.limit(0), its).count() == 0 and leakage.leaked(docs, its.limit(0)).count() == 0


def test_every_planted_passage_is_found():
    items, w = items_and_words(20, 90)
    rnd = random.Random(11)
    for _ in range(150):
        i = rnd.randrange(20)
        n = rnd.randint(21, 60)
        a = rnd.randrange(90 - n)
        p = list(w[i][a : a + n])
        for k in range(rnd.randrange(7), n - 1, 7):
            if 0 < k < n - 1 and rnd.random() < 0.8:
                p[k] = rnd.choice(("about", "maybe", "certain"))
        lines, k = [], 0
        while k < n:
            step = rnd.randint(3, 9)
            lines.append("# " + " ".join(p[k : k + step]))
            if rnd.random() < 0.4:
                lines.append(f"call_{k}(some, other, things, here)")
            k += step
        assert found_in("import x\n" + "\n".join(lines) + "\nreturn 1", items) == {i}, lines


def test_replaced_words_close_together():
    # every 20 words of these 28 hold all four replaced ones, which is more than 20 words may have
    items, w = items_and_words()
    p = [x if k not in (8, 11, 14, 17) else "maybe" for k, x in enumerate(w[5][:28])]
    items[5] = " ".join(w[5][:28])
    assert found_in("other " + " ".join(p) + " words", items) == {5}
    p[20] = "maybe"
    assert found_in("other " + " ".join(p) + " words", items) == set()


def test_replaced_words_in_a_row_part_no_passage():
    items, w = items_and_words(12, 90)
    for size, start, row in ((32, 14, 4), (36, 20, 4), (35, 15, 5), (70, 30, 10)):
        p = list(w[5][10 : 10 + size])
        p[start : start + row] = ["maybe"] * row
        text = "other " + " ".join(p) + " words"
        ((i, a, z),) = leakage.Matcher(leakage.bodies(items)).items_in(text)
        assert i == 5 and text[a:z] == " ".join(p)
    p = list(w[5][10:30])
    p[8:11] = ["maybe"] * 3
    assert found_in(" ".join(p), items) == set()


def test_one_form_for_items_and_documents():
    import unicodedata

    words = [f"café{i}né" if i % 2 else f"größe{i}" for i in range(40)]
    items = {1: " ".join(words), 2: " ".join(f"x{i}" for i in range(40))}
    plain = " ".join(words[5:30])
    forms = (
        plain, unicodedata.normalize("NFD", plain), unicodedata.normalize("NFD", plain).upper(), "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in plain),
        "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in unicodedata.normalize("NFD", plain)), "".join(f"\\u{ord(c):04x}" if ord(c) > 127 else c for c in plain),
        plain.replace("é", "&eacute;").replace("ö", "&ouml;"), plain.replace("caf", "ca\u00adf"), plain.replace(" ", " &lt;br&gt; "), plain.replace(" ", "\\u003cbr/\\u003e"), "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in plain),
    )
    for text in forms:
        ((i, a, z),) = leakage.Matcher(leakage.bodies(items)).items_in("before " + text + " after")
        assert i == 1 and ("before " + text + " after")[a:z] == text, text
    for text in (*forms, "a\\x41b &amp; <b>c</b> %20d\ufeff &#x1F600; \\ud83d", "", "\u0301", "½ ﬀ ﷺ"):
        assert len(leakage.words_of(text)) == len(leakage.places_of(text)[0])


def test_items_compete_for_altered_passages():
    rnd = random.Random(4)
    turn = "on every third day a {} tile rolls from the attic into the garden whereupon somebody pays for it and {} keeps the {} ribbons before dusk".split()
    items, bodies = {}, {}
    for i in range(6):
        own = [f"own{i}w{k}" for k in range(40)]
        bodies[i] = own[:20] + [x if x != "{}" else f"slot{i}{k}" for k, x in enumerate(turn)] + own[20:]
        items[i] = " ".join(bodies[i])
    for _ in range(40):
        i, a = rnd.randrange(6), rnd.randrange(10, 24)
        p = bodies[i][a : a + 30]
        for k in rnd.sample(range(1, 29), 2):
            p[k] = "other"
        assert found_in("so " + " ".join(p) + " it", items) == {i}
    # the turn of phrase with new words belongs to nobody; the junction of two whole passages to these two
    assert found_in(" ".join(x if x != "{}" else "new" for x in turn), items) == set()
    assert found_in(" ".join(bodies[0][20:44] + bodies[1][30:60]), items) == {0, 1}
    # items that share the very words all carry them
    items[9] = "before " + " ".join(bodies[3][:30])
    p = bodies[3][:24]
    p[4] = "other"
    assert found_in(" ".join(p), items) == {3, 9}


def test_short_lines_parted_by_other_lines():
    items, w = items_and_words()
    p = w[4][5:33]
    for step in (1, 2, 3):
        text = "\n".join(f"{' '.join(p[k : k + step])}\nsome call_{k} of other things" for k in range(0, 28, step))
        if step < 3:  # a document in which nothing stands unbroken is not aligned
            text += "\n" + " ".join(w[2][:3])
        assert found_in(text, items) == {4}


def test_repeating_documents_take_linear_time():
    items, w = items_and_words()
    text = "\n".join(" ".join(w[3][k : k + 4]) for _ in range(700) for k in (0, 10, 20))
    assert found_in(text, items) == set()
    assert found_in(text + "\n" + " ".join(w[3][:25]), items) == {3}


# --- subjects

TOPICS = {"food": "oven flour butter pastry whisk garlic simmer recipe".split(), "law": "court plaintiff statute verdict appeal clause juror hearing".split(), "music": "violin tempo chord melody rhythm sonata choir octave".split()}
PLAIN = "list value index total record name entry unit row size".split()


def topic_text(rnd, own, lines=14):
    out = []
    for _ in range(lines):
        words = TOPICS[rnd.choice(own)] if own and rnd.random() < 0.7 else PLAIN
        a, b, c = (rnd.choice(words) for _ in range(3))
        out.append(rnd.choice((f"{a}_{b} = {rnd.choice(PLAIN)}({c!r})", f"// the {a} of a {b} is never larger than {c}", f"if ({a}{b.title()} < 3) return {c.upper()};")))
    return "\n".join(out)


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    owns = [rnd.choice(([], ["food"], ["law"], ["music"], ["food", "law"])) for _ in range(n)]
    return [topic_text(rnd, o) for o in owns], owns


def test_held_out_accuracy():
    texts, owns = corpus()
    rnd = random.Random(5)
    noisy = [set(o) if rnd.random() > 0.08 else {rnd.choice(list(TOPICS))} for o in owns]
    model = subjects.calibrated(subjects.corpus([subjects.tokenized(t) for t in texts]), noisy, sorted(TOPICS))
    test, truth = corpus(200, 2)
    got = [set(model.accept(model.weights(subjects.tokenized(t)))) for t in test]
    right = sum(len(g & set(o)) for g, o in zip(got, truth, strict=True))
    assert right / max(1, sum(map(len, got))) > 0.95 and right / sum(len(o) for o in truth) > 0.93


def test_words_and_headers():
    assert subjects.tokenized(None) == [] and subjects.tokenized("") == [] and subjects.tokenized("HTTPServer fooBar_baz2\\nnext") == [["http", "server", "foo", "bar", "baz"], ["next"]]
    for kept in ("# returns nothing when the copyright is missing\ncode", "/* the copyright of a bail */\ncode", "/* see also */ code"):
        assert subjects.without_header(kept) == kept
    assert subjects.without_header("/*! MIT licence, no warranty */court(1);\n\nb") == "court(1);\n\nb" and subjects.without_header("/* (c) 2020 X */ a = 1") == " a = 1"
    header = "# Licence: X\n# the court and the tribunal hear claims\n\n"
    assert subjects.without_header(header + "code = 1") == "\ncode = 1" and subjects.without_header("# a remark\ncode") == "# a remark\ncode"
    assert "court" not in str(subjects.tokenized("/*\n * Copyright somebody, court\n */\ncode()")) and subjects.plain("courts") == "court" and subjects.skeleton("tanker") == "tnkr"


def test_abbreviations_lean_on_words():
    texts, owns = corpus()
    model = subjects.train([subjects.tokenized(t) for t in texts], [set(o) for o in owns], sorted(TOPICS))
    for word, own in (("plntff", "law"), ("vln", "music"), ("butterpast", "food")):
        assert model.subjects[int(np.argmax(model.resolved(word)[1]))] == own
    assert not model.resolved("zzzzqqq")[1].any()


def test_subject_areas(spark):
    texts, owns = corpus(250)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "{}" * 10), (903, texts[0] + "\n" + "value = 1\n" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"subject": F.lit("x"), "share": F.lit(1)})
    labels = [(i, s.upper() if i % 9 == 0 else s, "a") for i, o in enumerate(owns) if i % 2 for s in (o or ["none"])] * 2 + [(None, "law", "a"), (5, None, "a"), (77777, "law", "b"), (6, "unknown", "b")]
    labels = spark.createDataFrame(labels, "doc_id long, subject string, annotator string").withColumn("text", F.lit("q"))
    codes = spark.createDataFrame([(s, "") for s in TOPICS], "subject string, about string")
    got = {}
    for r in subjects.subject_areas(docs, labels, codes).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert np.mean([got.get(i, set()) == set(o) for i, o in enumerate(owns)]) > 0.9 and not {900, 901, 902} & set(got)
    assert subjects.subject_areas(docs, labels.limit(0), codes).count() == 0 and subjects.subject_areas(docs, labels, codes.limit(0)).count() == 0 and subjects.subject_areas(docs.limit(0), labels, codes).count() == 0


def test_subjects_learnt_from_all_labelled_documents(spark):
    rnd = random.Random(3)
    order = [r.id for r in spark.range(12_500).orderBy(F.xxhash64("id"), "id").collect()]
    owns = {i: ["music"] if at >= 12_200 else [["food"], ["law"], []][at % 3] for at, i in enumerate(order)}
    docs = spark.createDataFrame([(i, topic_text(rnd, o, 6)) for i, o in owns.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, s, "a") for i, o in owns.items() for s in (o or ["none"])], "doc_id long, subject string, annotator string")
    codes = spark.createDataFrame([(s, "") for s in TOPICS], "subject string, about string")
    got = {r.doc_id for r in subjects.subject_areas(docs, labels, codes).where("subject = 'music'").collect()}
    music = {i for i, o in owns.items() if o == ["music"]}
    assert len(got & music) > 0.9 * len(music) and len(got - music) < 0.05 * len(music)


def test_subjects_every_text_is_learnt(spark):
    docs = spark.createDataFrame([(1, "court"), (1, "court"), (1, "verdict"), (2, ""), (3, None), (4, "oven")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "LAW"), (1, "law"), (1, "else"), (2, "none"), (3, "law")], "doc_id long, subject string")
    items = spark.createDataFrame([(f"item {x}",) for x in "abcabc"] + [(None,), ("",)], "text string")
    got = sorted((r.half == 2, r.lines, r.own) for r in subjects.labelled(docs, labels, ["law"], items).collect())
    assert got == [(False, "", []), (False, "court", ["law"]), (False, "verdict", ["law"])] + [(True, "item", [])] * 3


def test_subjects_passes_over_parts(spark):
    texts, owns = corpus(240)
    codes, docs = sorted(TOPICS), [subjects.tokenized(t) for t in texts]
    words = sorted({w for d in docs for line in d for w in line})
    number, half = {w: i for i, w in enumerate(words)}, np.arange(240) % 3
    side, weight = np.arange(240) // 3 % 2, np.where(half == 2, 0.3, 1.0)
    parts = [subjects._part(subjects.corpus(docs[a:b]), number, [set(o) for o in owns[a:b]], codes, half[a:b], side[a:b], weight[a:b], 3) for a, b in ((0, 240), (0, 7), (7, 150), (150, 240))]
    usable = np.ones((3, len(words)), bool)
    usable[1, ::5] = usable[2, ::7] = False
    rows = spark.createDataFrame([(-1, bytearray(pickle.dumps(p))) for p in parts[1:]], "block int, part binary").repartition(2)
    for a, b in zip(subjects.fitted(subjects.Here(parts[:1]), words, usable, codes), subjects.fitted(subjects.There(kept(rows)), words, usable, codes), strict=True):
        assert a.words == b.words and np.array_equal(a.pairs, b.pairs)
        assert all(np.allclose(x, y, rtol=1e-4, atol=1e-6) for x, y in ((a.p, b.p), (a.counted, b.counted), (a.first_mass, b.first_mass)))
