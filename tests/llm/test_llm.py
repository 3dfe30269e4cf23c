import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.llm import _align, _bpe, _kn, _words, cross_split, eval_leaks, group_splits, lang_labels, mixing, pairs, passages, pieces, shared_spans, tokens

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choices(string.ascii_lowercase, k=RNG.randint(2, 8))) for _ in range(400)]


def say(n, rng=RNG):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# Words and grams


def test_grams_equal_for_equal_words_only():
    a = np.random.default_rng(0).integers(1, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[100:200], a[:50]])
    ga, gb = _words.grams(a, 8), _words.grams(b, 8)
    assert (ga[100:193] == gb[:93]).all() and len(set(ga.tolist())) == 293
    assert len(_words.grams(a[:7], 8)) == 0


def test_winnowing_selects_in_every_window_and_alike():
    g = np.random.default_rng(1).integers(1, 2**63, 400).astype(np.uint64)
    at = _words.winnow(g, np.ones(400, bool), 26)
    assert all(any(i <= p < i + 26 for p in at) for i in range(375))
    part = _words.winnow(g[50:150], np.ones(100, bool), 26)
    assert set(part + 50) <= set(at)


def test_plain_words_forget_case_accents_marks_and_markup():
    cache = _words.PlainHashes()
    hashes = lambda t: [h for w in _words.plain_words(t) if (h := cache[w])]
    assert hashes("<p>L’Été, — «noir»&nbsp;</p>") == hashes("l'ete noir") == hashes("LÉté NOIR".replace("LE", "L'E"))


# Problem 1


def brute_spans(records, least):
    words = {}
    for table, key, text in records:
        if key is not None and text is not None:
            words[table, key] = [w for w in text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    where = {}
    for rec, w in words.items():
        for i in range(len(w) - least + 1):
            where.setdefault(tuple(w[i : i + least]), set()).add(rec)
    out = []
    for rec, w in words.items():
        on = [False] * len(w)
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                on[i : i + least] = [True] * least
        i = 0
        while i < len(w):
            if on[i]:
                j = i
                while j < len(w) and on[j]:
                    j += 1
                out.append((*rec, i, j - i))
                i = j
            i += 1
    return sorted(out)


def held(factors, records):
    """Every factor stands in its reference, word for word."""
    words = {r[:2]: [w for w in re.split("[ \\t\\r\\n]+", r[2]) if w] for r in records if r[1] is not None and r[2] is not None}
    for f in factors.collect():
        own, ref = words[f.rec_table, f.rec_key], words[f.ref_table, f.ref_key]
        assert (f.rec_table, f.rec_key) != (f.ref_table, f.ref_key) and f.n_words >= 50
        assert own[f.first_word : f.first_word + f.n_words] == ref[f.ref_word : f.ref_word + f.n_words] and f.first_word + f.n_words <= len(own)


def test_factors_stand_in_their_reference(spark):
    rng = random.Random(11)
    w = [f"w{i}" for i in range(52)]
    records = [("essays", "A", " ".join(w)), ("essays", "B", " ".join(w[:51] + say(31, rng) + w[1:]))]
    long, mark = say(300, rng), say(60, rng)
    records += [("essays", "L", " ".join(long[100:160])), ("recreation", "M", " ".join(say(9, rng) + long)), ("recreation", "N", " ".join(long + say(9, rng))), ("essays", "O", " ".join((mark * 4)[:200])), ("essays", "P", " ".join(mark * 2))]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(records)], "rec_table string, rec_key string, text string, start long")
    factors = shared_spans.factors(df)
    held(factors, records)
    assert rows(shared_spans.spans(factors), "rec_table", "rec_key", "first_word", "n_words") == brute_spans(records, 50)
    of = {}
    for f in factors.collect():
        of.setdefault(f.rec_key, []).append((f.first_word, f.n_words, f.ref_key))
    assert len(of["A"]) == len(of["B"]) == 2 and sorted(of["A"])[0][0] == 0 and max(x + n for x, n, _ in of["A"]) == 52
    assert all(any(n == 300 for _, n, _ in of[k]) or len(of[k]) <= 3 for k in "MN")  # one factor, or broken where L is both first and last holder


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(7)
    a, b, hot = say(120, rng), say(49, rng), say(60, rng)
    records = [
        ("essays", "1", " ".join(say(30, rng) + a + say(20, rng) + b)), ("essays", "2", "  " + "\n".join(a[10:100]) + "\t" + " ".join(a[40:120])), ("recreation", "1", " ".join(b + say(60, rng))),
        ("essays", "3", " ".join(a[:60] + a[70:])), ("essays", "4", None), ("essays", "5", ""), ("essays", None, " ".join(a)), ("essays", "6", " ".join(["x"] * 200)), ("essays", "6", " ".join(["x"] * 200)),
        ("recreation", "7", " ".join(["x"] * 70 + say(10, rng))), ("essays", "8", " ".join(a).upper()),
    ] + [("essays", f"h{i}", " ".join(say(rng.randint(0, 40), rng) + hot[rng.randint(0, 12) :] + say(5, rng))) for i in range(40)]
    df = spark.createDataFrame([(*r, "clash") for r in records], "rec_table string, rec_key string, text string, rec string")
    factors = shared_spans.factors(df)
    got = rows(shared_spans.spans(factors), "rec_table", "rec_key", "first_word", "n_words")
    assert got == brute_spans(records, 50)
    held(factors, records)
    amount = {(r.rec_table, r.rec_key): r for r in shared_spans.shared_amount(shared_spans.spans(factors), df).collect()}
    assert amount["essays", "4"].share == 0 and amount["essays", "6"].share == 1.0 and amount["essays", "5"].words == 0


def test_shared_spans_of_an_empty_table(spark):
    df = spark.createDataFrame([], "rec_table string, rec_key string, text string")
    assert shared_spans.spans(shared_spans.factors(df)).count() == 0


# Problem 2


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            root[find(a)] = find(b)
    groups = {}
    for x in list(root):
        groups.setdefault(find(x), set()).add(x)
    return sorted(tuple(sorted(g)) for g in groups.values() if len(g) > 1)


def test_forest_spans_the_components(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}", str(rng.randint(0, 3))) for _ in range(45)] + [(f"c{i}", f"c{i + 1}", "0") for i in range(20)] + [(None, "n1", "0"), ("n1", None, "0")]
    forest, of = group_splits.spanning_forest(spark.createDataFrame(edges, "a string, b string, weight string"))
    groups = {}
    for r in of.collect():
        groups.setdefault(r.root, set()).add(r.node)
    got = sorted(tuple(sorted(g)) for g in groups.values())
    assert got == brute_components([(a, b) for a, b, _ in edges if a != b])
    assert forest.count() == sum(len(g) - 1 for g in got)
    assert brute_components([(r.a, r.b) for r in forest.collect()]) == got


def test_splits_keep_links_and_proportions(spark):
    rng = random.Random(4)
    chunk = []
    for i in range(3000):
        author = rng.choice([None, "", "unknown", " Unknown "]) if rng.random() < 0.1 else f"Author  {rng.randint(0, 400)}".upper() if rng.random() < 0.3 else f"author {rng.randint(0, 400)}"
        chunk.append((f"k{i}", f"doc {i // 3}" if rng.random() < 0.97 else rng.choice([None, " "]), author, "clash"))
    for i in range(0, 3000, 3):  # the author of a document, but for a few
        a = chunk[i][2]
        for j in (1, 2):
            if rng.random() < 0.99:
                chunk[i + j] = (chunk[i + j][0], chunk[i + j][1], a, "clash")
    chunk += chunk[:50]
    df = spark.createDataFrame(chunk, "chunk_id string, source_doc_id string, author string, root string")
    got = group_splits.splits(df).collect()
    assert Counter(r.chunk_id for r in got) == Counter({c[0] for c in chunk})
    split = {r.chunk_id: r.split for r in got}
    by = {}
    for k, s, a, _ in chunk:
        name = " ".join((a or "").lower().split())
        for link in (("s", s) if s and s.strip() else None, ("a", name) if name not in ("", "unknown") else None):
            if link:
                by.setdefault(link, set()).add(split[k])
    assert all(len(x) == 1 for x in by.values())
    n = Counter(split.values())
    assert n["train"] > n["validation"] and set(n) <= {"train", "validation", "test"}
    assert group_splits.linked_authors(df.limit(0)).count() == 0 and group_splits.splits(df.limit(0)).count() == 0


def test_bands_are_dealt_in_proportion(spark):
    comps = spark.createDataFrame([(f"r{i}", 1 + i % 40) for i in range(4000)], "root string, rows long")
    got = {r.split: r.n for r in group_splits.dealt(comps).groupBy("split").agg(F.sum("rows").alias("n")).collect()}
    total = sum(got.values())
    assert got["train"] / total == pytest.approx(0.8, abs=0.01) and got["test"] / total == pytest.approx(0.1, abs=0.01)


# Problem 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=0, max_size=300), st.integers(10, 60), st.integers(0, 4))
def test_cuts_cover_within_limit_at_the_strongest_place(strength, limit, overlap):
    s = np.array(strength, np.int8)
    got = pieces.cuts(s, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(s)
    for (b, e, x), (c, _, _) in zip(got, got[1:]):
        assert 0 < e - b <= limit and c == e - overlap
        least = max(limit // 2, overlap + 1)
        window = strength[b + least - 1 : b + limit]
        assert x == max(window) and e - 1 == b + least - 1 + max(i for i, v in enumerate(window) if v == x)


def test_pieces_of_essays_and_chunks(spark):
    text = "\n\n".join(". ".join(" ".join(say(11)) for _ in range(9)) + "." for _ in range(20))
    e = spark.createDataFrame([("a", text), ("a", text), ("b", "short"), ("c", None), (None, text), ("d", "")], "article_id string, text string")
    got = pieces.essay_pieces(e, 300, 60).orderBy("piece").collect()
    words = text.split()
    assert {r.item_id for r in got} == {"a"} and [r.text.split() for r in got] == [words[r.first_unit : r.first_unit + r.n_units] for r in got]
    assert all(r.n_units <= 300 for r in got) and all(r.cut == "paragraph" for r in got)
    t = (["a", "b", ".", "”"] * 60)[:235] + [None, ""]
    c = spark.createDataFrame([("k", t), ("n", None), ("s", ["x"])], "chunk_id string, tokens array<string>")
    got = pieces.chunk_pieces(c, 100, 40).orderBy("piece").collect()
    assert [r.tokens for r in got] == [t[r.first_unit : r.first_unit + r.n_units] for r in got]
    assert all(t[r.first_unit + r.n_units - 1] == "”" for r in got[:-1]) and len(got) > 2


# Problem 4


def test_empty_and_refusals():
    for body in (None, "", " \n", "​", "﻿", "N/A", "[no output]", '""', "-", "(empty)", "TBD", "null"):
        assert pairs.is_empty(body)
    for body in ("no", "None of us left.", "A"):
        assert not pairs.is_empty(body)
    for body in ("I’m sorry, but I can’t write this piece.", "Thanks for sending this over. Sorry, can't do that.", "As a language model, I have to decline this assignment.", "Lo siento, pero no puedo escribir este texto.", "Es tut mir leid, aber dabei kann ich nicht helfen.", "Il m’est impossible de répondre à cette demande.", "К сожалению, я не могу написать этот текст."):
        assert pairs.is_refusal(body), body
    for body in ("Sorry is a word that this town has heard too often.", "She was unable to help, the clerk said, and closed the window.", "I must decline, he wrote back, and that was the end of it.", "As a language teacher I have declined many invitations.", "I cannot help noticing how quiet it has become."):
        assert not pairs.is_refusal(body), body


def test_copies():
    prompt = " ".join(say(60))
    changed = prompt.split()
    changed[5] = changed[20] = "other"
    for body in (prompt, f"Assignment: {prompt}", f"{prompt}\n\n{prompt}", " ".join(changed), " ".join(prompt.split()[:45])):
        assert pairs.is_copy(body, prompt)
    for body in (f"{prompt} {' '.join(say(200))}", " ".join(say(60)), " ".join(prompt.split()[:8])):
        assert not pairs.is_copy(body, prompt)
    assert not pairs.is_copy(prompt, None) and not pairs.is_copy("a", "a b c")


def test_endings():
    whole = "The vote was close. It was said."
    for tail in ("", "\n\n— Ann Lee", "\n\n* * *", "\n\nFiled under: trade", "\n\n(ends)", "\n\nTHE END", " 😀", "\n\n“La vita”", "”"):
        assert pairs.ending(whole + tail)[0] == "whole", tail
    for body in ("The vote was close and of the", "It is said…", "It was so ...", whole + " Provided that —", whole + "\n\nBeyond the angry treasury,", 'So the "'):
        assert pairs.ending(body)[0] == "cut", body
    assert pairs.ending(whole + "\n\nThe press within the budget")[0] == "heading"


def test_defects(spark):
    sample = [(i, x, t) for i, (x, t) in enumerate([("en", "the cat is on the mat and we have it"), ("de", "die katze ist auf der matte und wir haben sie")] * 8)]
    samples = spark.createDataFrame(sample, "sample_id long, lang string, text string")
    prompt = "Write of the cat that is on the mat, and of what we have of it."
    body = [
        (1, None, 5, prompt), (2, "We have the cat, and it is on the mat.", 9, prompt), (3, "Wir haben die Katze, und sie ist auf der Matte.", 9, prompt), (4, "We have the cat on the", None, prompt),
        (5, "The cat is on the mat.", 30, None), (6, "We have it.\n\nThe cat within the mat", 8, prompt), (7, "We have it.\n\nThe cat explains", 5, prompt), (8, prompt, 16, prompt),
    ]
    df = spark.createDataFrame(body, "rec_id long, body string, word_count int, prompt string").withColumn("key", F.lit("clash"))
    titles = spark.createDataFrame([("The mat within the mat",), ("A cat",), (None,)], "title string")
    got = rows(pairs.defects(df, titles, samples).where("rank = 1"), "rec_id", "defect")
    assert got == [(1, "empty"), (3, "wrong_lang"), (4, "truncated"), (5, "truncated"), (7, "truncated"), (8, "copy")]
    assert pairs.defects(df.limit(0), titles, samples).count() == 0


# Problems 5, 8 and 9

ODD = ["", " ", "  a  b ", "a\n\n b\t c", "don't 's", "x" * 700, "ab" * 300, "\u0085 b\x1c a", "Ünï ½²③ 👩‍💻", "﻿​", "<|endoftext|> a", "　全角 文字"]


def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(_bpe.DEFAULT_FILE.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("text", [
    "I'm sorry, the minister wrote about this before and I cannot write this essay.", "I won't be able to imitate her.", "Apologies: I’d rather not compose an article in her voice.", "My answer has to be no.",
    "Diese Aufgabe muss ich leider ablehnen.", "Je dois décliner cette tâche.", "No me es posible ayudar con esta petición.", "Non posso scrivere questo articolo.", "Não posso escrever este texto.", "Ik kan deze tekst niet schrijven.", "Я не могу написать этот текст.",
    " ".join(["The town waits."] * 120) + " I must decline this request.", "“I cannot help with that.”",
])
def test_refusals_of_any_length_and_language(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize("text", [
    "I will not write about the weather again, I promised, and here I am.", "I cannot help noticing the bridge.", "The clerk said: “I cannot write this essay.” So it went.", "The town cannot afford it, and I will not miss it.",
    "Ich kann den Fluss nicht sehen.", "Non posso dormire.", "He declined the request.",
])
def test_no_refusals(text):
    assert not pairs.is_refusal(text)


def test_delimiters_prefixes_remarks_and_scripts():
    whole = "It was late. The town slept."
    assert not pairs.is_open(whole) and not pairs.is_open("He said (twice) “no”. „Ja“, sagte er.")
    assert all(pairs.is_open(x) for x in (whole + " It was [late.", "```\ncode.", whole + " “And so on."))
    ask = "Write forty words about the bridge over the river and close with a memory of school."
    assert pairs.is_copy(ask + " " + " ".join(say(20)), ask) and not pairs.is_copy(ask + " " + " ".join(say(200)), ask)
    assert pairs.is_empty("[intentionally left blank by the author here]") and pairs.is_empty("* * * null * * *") and pairs.is_empty("N/A\nN/A") and not pairs.is_empty("[He slept.] Then he woke.")
    assert pairs.script("Мост over") == 2 and pairs.script("abc") == 1 and pairs.script("123 …") is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoding_equals_the_library(text):
    enc, lib = _bpe.encoder(), library()
    want = lib.encode(text, add_special_tokens=False).ids
    assert enc.ids(text) == want and enc.count(text) == len(want)


def test_odd_texts_and_round_trip(spark):
    lib, enc = library(), _bpe.encoder()
    back = {v: k for k, v in enc.ranks.items()}
    for t in ODD:
        assert enc.ids(t) == lib.encode(t, add_special_tokens=False).ids and b"".join(back[i] for i in enc.ids(t)).decode() == t
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got == {i: enc.ids(t) for i, t in enumerate([*ODD, None])}
    assert tokens.encode(df.limit(0)).count() == 0


def test_rank_file_goes_along_with_the_job(spark, tmp_path):
    import shutil

    away = tmp_path / "ranks.tiktoken"
    shutil.copy(_bpe.DEFAULT_FILE, away)
    _bpe.ship(spark, str(away))
    assert spark.sparkContext.parallelize([0], 1).map(lambda _: len(_bpe.read_ranks("/nowhere/ranks.tiktoken"))).first() == len(_bpe.encoder().ranks)


def test_budget_is_exact(spark):
    rng = random.Random(1)
    data = [(i if i % 9 else None, rng.choice(["s", "t", None]), rng.choice(["en", None]), rng.choice([None, "", " ".join(say(20, rng)), *ODD])) for i in range(200)]
    df = spark.createDataFrame([(*r, "clash") for r in data + [r for r in data[:40] if r[0]]], "key long, source string, lang string, text string, c0 string")
    want, all_ = {}, 0
    for _, s, x, t in data:
        n, k = want.get((s, x), (0, 0))
        want[s, x] = (n + 1, k + _bpe.encoder().count(t))
        all_ += _bpe.encoder().count(t)
    sized = tokens.once(tokens.count(df, "key", keep=["source", "lang"]), "key")
    assert {(r.source, r.lang): (r.records, r.tokens) for r in tokens.budget(sized, ["source", "lang"]).collect()} == want
    total = {(r.level, r.source, r.lang): (r.records, r.tokens) for r in tokens.totals(sized, ["source", "lang"]).collect()}
    assert total["all", None, None] == (200, all_) and total["source", "s", None] == tuple(map(sum, zip(*(v for (s, _), v in want.items() if s == "s"))))
    assert {k[1:]: v for k, v in total.items() if k[0] == "source+lang"} == want
    assert [tuple(r) for r in tokens.totals(sized.limit(0), ["source", "lang"]).collect()] in ([], [("all", None, None, 0, 0)])


def test_repeated_keys_are_one_record(spark):
    df = spark.createDataFrame([(1, "a", "one two"), (1, "a", "one two"), (1, "a", "one two"), (None, "a", "x"), (None, "a", "x")], "doc_id long, source string, text string")
    got = tokens.once(tokens.count(df, keep=["source"]))
    assert got.columns == ["doc_id", "source", "n_tokens"] and [r.doc_id for r in got.orderBy("doc_id").collect()] == [None, None, 1]


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=12), st.integers(0, 3000))
def test_fit_is_the_best_sum_and_within_counts(counts, budget):
    passes, take = mixing.fit(list(counts.items()), budget)
    total = sum(n * k for n, k in counts.items())
    got = passes * total + sum(n * k for n, k in take.items())
    assert got <= budget and passes == budget // total and all(0 < k <= counts[n] for n, k in take.items())
    assert budget - got < max(counts)  # no document that is left would fit, or the sum is met


def test_knapsack_is_exact():
    rng = random.Random(2)
    for _ in range(50):
        lengths = [(rng.randint(1, 30), rng.randint(1, 4)) for _ in range(5)]
        lengths = list(dict(lengths).items())
        want = rng.randint(0, 150)
        sums = {0}
        for n, k in lengths:
            sums = {s + n * j for s in sums for j in range(k + 1)}
        took = mixing._knapsack(lengths, want)
        assert sum(n * k for n, k in took.items()) == max(s for s in sums if s <= want)


def test_mix_reaches_shares(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None]), rng.randint(0, 50)) for i in range(600)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    weights = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.1, 4), ("none", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    budgets, chosen = mixing.plan(sized, weights)
    drawn = mixing.draw(sized, chosen)
    got = {r.source: r for r in mixing.shares(budgets, drawn).collect()}
    total, budget = sum(n for _, _, n in docs), {r.source: r.budget for r in budgets.collect()}
    have = Counter()
    for _, s, n in docs:
        have[s] += n
    assert budget == {s: min(int(total * w), have[s] * m) for s, w, m in [("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.1, 4), ("none", 0.1, 2)]}
    assert all(r.tokens == budget[s] and r.most_repeats <= r.max_repeats for s, r in got.items())
    assert got["none"].tokens == 0 and got["a"].share == pytest.approx(0.5, abs=1e-3) and sum(r.share_of_drawn for r in got.values()) == pytest.approx(1)
    assert rows(drawn, "doc_id", "repeats") == rows(mixing.draw(sized, chosen), "doc_id", "repeats")
    big = {r.source: r for r in mixing.shares(*(lambda b, c: (b, mixing.draw(sized, c)))(*mixing.plan(sized, weights, 10**6))).collect()}
    assert big["a"].most_repeats == 2 and big["a"].short_tokens > 0
    most = mixing.reachable_total(sized, weights)
    fair = {r.source: r for r in mixing.shares(*(lambda b, c: (b, mixing.draw(sized, c)))(*mixing.plan(sized, weights, most))).collect()}
    assert all(r.short_tokens == 0 for s, r in fair.items() if s != "none") and mixing.reachable_total(sized.limit(0), weights) == 0
    assert mixing.draw(sized.limit(0), mixing.plan(sized.limit(0), weights)[1]).count() == 0


# Problems 6 and 7


def edited(words, changes, rng):
    out = list(words)
    for _ in range(changes):
        i, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[i] = "changed"
        elif kind == 1:
            out.insert(i, "added")
        else:
            del out[i]
    return out


def test_leaks_find_edited_passages_only(spark):
    rng = random.Random(11)
    tests = {f"t{i}": say(150, rng) for i in range(12)}
    corpus, want = {}, set()
    for i, (k, w) in enumerate(tests.items()):
        part = w[30:90]
        corpus[f"c{i}"] = say(40, rng) + edited(part, 4, rng) + say(40, rng)
        want.add((f"c{i}", k))
        corpus[f"n{i}"] = say(40, rng) + w[60:90] + say(40, rng)  # too short
        corpus[f"u{i}"] = say(60, rng)
    corpus["copy"] = [w.upper() + "," for w in tests["t0"]]
    want.add(("copy", "t0"))
    t = spark.createDataFrame([(k, " ".join(w), "x") for k, w in tests.items()] + [("null", None, "x"), (None, "a b", "x"), ("empty", "", "x"), ("t0", " ".join(tests["t0"]), "x")], "article_id string, text string, id string")
    c = spark.createDataFrame([(k, "\n".join(w), "x") for k, w in corpus.items()] + [("null", None, "x")], "article_id string, text string, q string")
    assert rows(eval_leaks.leaks(t, c), "corpus_key", "test_key") == sorted(want)
    assert eval_leaks.leaks(t.limit(0), c).count() == 0


def test_leaks_grow_with_the_passage(spark):
    rng = random.Random(17)
    tests, corpus, want = {}, {}, set()
    for i, n in enumerate([*range(40, 81), 50, 60, 70] * 2):
        w = say(n + 40, rng)
        part = w[20 : 20 + n]
        if i < 44:
            at = rng.sample(range(2, n - 2), n // 10)  # anywhere but at the ends
        elif i % 2:
            at = range(10, 10 + n // 10)  # clustered after the tenth word
        else:
            at = [10 + 5 * k for k in range(n // 10)]
            at = at if n >= 50 else [2 + 9 * k for k in range(n // 10)]
        tests[f"t{i}"] = w
        corpus[f"c{i}"] = say(30, rng) + [f"new{p}" if p in at else x for p, x in enumerate(part)] + say(30, rng)
        want.add((f"c{i}", f"t{i}"))
    for i in range(10):  # a passage's end can't be told from a shorter quotation's
        tests[f"s{i}"] = w = say(100, rng)
        corpus[f"s{i}"] = say(30, rng) + w[30 : 66 + i % 4] + say(30, rng)
        tests[f"m{i}"] = w = say(100, rng)
        corpus[f"m{i}"] = say(30, rng) + [f"new{p}" if p % 8 == 5 else x for p, x in enumerate(w[20:80])] + say(30, rng)  # more than a tenth, in any 40 words
    df = lambda d: spark.createDataFrame([(k, " ".join(w)) for k, w in d.items()], "article_id string, text string")
    assert rows(eval_leaks.leaks(df(tests), df(corpus)), "corpus_key", "test_key") == sorted(want)


def test_crowded_runs_part_by_their_surroundings(spark, monkeypatch):
    monkeypatch.setattr(passages, "CROWD", 5)
    monkeypatch.setattr(passages, "CROWD_TIMES", 0)
    rng = random.Random(13)
    slogan = say(12, rng)
    tests = {f"t{i}": say(50, rng) + slogan + say(50, rng) for i in range(30)}
    corpus = {f"c{i}": say(30, rng) + slogan + say(30, rng) for i in range(30)}
    want = set()
    for i in range(10):  # the slogan is the only common run of 8 words, as a change follows each 7 others
        w = tests[f"t{i}"][42:82] if i % 2 else tests[f"t{i}"][30:70]
        at = [p for p in (5, 27, 33, 37) if i % 2] or [2, 7, 13, 37]
        corpus[f"e{i}"] = say(20, rng) + [f"new{i}" if p in at and 0 < p < 39 else x for p, x in enumerate(w)] + say(20, rng)
        want.add((f"e{i}", f"t{i}"))
    df = lambda d: spark.createDataFrame([(k, " ".join(w)) for k, w in d.items()], "article_id string, text string")
    assert passages.Tables(df(tests).withColumnRenamed("article_id", "id")).crowded.sum() > 0
    assert rows(eval_leaks.leaks(df(tests), df(corpus)), "corpus_key", "test_key") == sorted(want)


def test_scan_skips_windows_but_no_pattern(spark):
    rng = random.Random(21)
    tests = spark.createDataFrame([(i, " ".join(say(60, rng))) for i in range(5)], "id long, text string")
    table = passages.Tables(tests)
    cache = passages._CACHE
    known = [cache[w] for r in tests.collect() for w in r.text.split()]
    flat = np.array([cache[f"new{i}"] for i in range(3000)] + known[:150] + [cache[f"other{i}"] for i in range(2000)], np.uint64)
    gram, stops = _words.grams(flat, 7), table.windows(flat)
    held = np.flatnonzero(np.isin(gram, _words.grams(np.array(known, np.uint64), 7)))
    patterns = set(held) & set(_words.winnow(gram, np.ones(len(gram), bool), 2))
    assert len(held) > 100 and patterns - set(stops) <= {p for p in patterns if not table.occupied(gram[p : p + 1])[0]}
    assert len(stops) < 500


def test_repetitive_and_tiny_texts(spark):
    rng = random.Random(22)
    df = lambda d: spark.createDataFrame([(k, t, 1) for k, t in d.items()], "article_id string, text string, id int")
    two = " ".join(rng.choice(["ja", "nein"]) for _ in range(300))
    one = " ".join(["ho"] * 500)
    corpus = {"c1": " ".join(say(40, rng)) + " " + two + " " + " ".join(say(40, rng)), "c2": " ".join(say(5, rng)) + " " + " ".join(["ho"] * 45) + " x", "c3": " ".join(["ho"] * 39)}
    assert rows(eval_leaks.leaks(df({"t1": two, "t2": one, "t3": "ho ho"}), df(corpus)), "corpus_key", "test_key") == [("c1", "t1"), ("c2", "t2")]
    for n in (1, 7, 10, 13):
        assert eval_leaks.leaks(df({"t": " ".join(say(n, rng))}), df(corpus)).count() == 0
    train = {"r1": two, "r2": one + " ho", "r3": " ".join(["ho"] * 300), "r4": "ho ho", "r5": " ".join(say(200, rng))}
    got = rows(cross_split.overlaps(df({"e1": two.upper(), "e2": one, "e3": "Ho, ho!", "e4": train["r5"]}), df(train)), "eval_key", "train_key", "edits")
    assert got == [("e1", "r1", 0), ("e2", "r2", 1), ("e3", "r4", 0), ("e4", "r5", 0)]


def test_a_run_in_very_many_articles_and_copies_of_one(spark):
    rng = random.Random(24)
    slogan, essay = say(12, rng), say(90, rng)
    corpus = [(f"c{i}", " ".join(say(20, rng) + slogan + say(20, rng))) for i in range(3000)] + [(f"k{i}", " ".join(say(5, random.Random(1)) + essay[20:70])) for i in range(1500)]
    tests = [("t1", " ".join(essay[:30] + essay[30:60] + slogan + essay[60:])), ("t2", " ".join(essay)), ("t2", " ".join(essay))]
    df = lambda d: spark.createDataFrame([(k, t, "clash") for k, t in d], "article_id string, text string, key string")
    got = rows(eval_leaks.leaks(df(tests), df(corpus)), "corpus_key", "test_key")
    assert got == sorted((f"k{i}", t) for i in range(1500) for t in ("t1", "t2"))


def test_common_runs_are_those_of_all_pairs():
    rng = random.Random(23)
    for _ in range(30):
        a, b = ([rng.randint(1, 3) for _ in range(rng.randint(0, 60))] for _ in range(2))
        want = set()
        for i in range(len(a)):
            for j in range(len(b)):
                if a[i] == b[j] and (not i or not j or a[i - 1] != b[j - 1]):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    want |= {(i, j)} if n >= 7 else set()
        assert set(_align.common_runs(a, b, 7)) == want


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25), st.integers(0, 12))
def test_distance_is_levenshtein(a, b, most):
    d = levenshtein(a, b)
    assert _align.distance(a, b, most) == (d if d <= most else None)


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(12)
    ev, tr = {}, {}
    for i, n in enumerate([3, 8, 10, 12, 20, 30, 40, 44, 45, 60, 120, 300] * 2):
        w = say(n, rng)
        ev[f"e{i}"] = w
        tr[f"near{i}"] = edited(w, n // 10, rng) if i < 12 else [x.title() + "!" for x in w]
        tr[f"far{i}"] = edited(w, n // 5 + 1, rng)
        tr[f"part{i}"] = w[: n // 2] + say(n, rng)
    want = sorted((k, t) for k, a in ev.items() for t, b in tr.items() if a and b and levenshtein([x.lower() for x in a], [x.lower().strip("!") for x in b]) <= max(len(a), len(b)) // 10)
    e = spark.createDataFrame([(k, " ".join(w), "x") for k, w in ev.items()] + [("z", None, "x"), ("b", " ", "x"), ("p", "- !", "x")], "article_id string, text string, c string")
    t = spark.createDataFrame([(k, " ".join(w), "x") for k, w in tr.items()] + [("b", "", "x"), ("p", "...", "x"), ("near0", " ".join(tr["near0"]), "x")], "article_id string, text string, g string")
    assert rows(cross_split.overlaps(e, t), "eval_key", "train_key") == want
    assert cross_split.overlaps(e, t.limit(0)).count() == 0


def test_nine_words_of_ten_are_a_near_copy(spark):
    w = say(10)
    df = lambda k, x: spark.createDataFrame([(k, " ".join(x))], "article_id string, text string")
    less = w[:5] + w[6:]
    assert rows(cross_split.overlaps(df("e", w), df("t", less)), "eval_key", "train_key") == [("e", "t")]
    assert rows(cross_split.overlaps(df("e", less), df("t", w)), "eval_key", "train_key") == [("e", "t")]


# Problem 10

TEXTS = {
    "en": "the council has always wanted the library and we know that it is not what it was because of the new budget in this town",
    "de": "der rat hat die bibliothek immer gewollt und wir wissen dass sie nicht mehr das ist was sie war wegen des neuen haushalts in dieser stadt",
    "ru": "совет всегда хотел библиотеку и мы знаем что она уже не та потому что новый бюджет в этом городе приходит слишком поздно",
}


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(1)
    data = [(i, x, " ".join(rng.sample(t.split(), 15) + t.split())) for i, (x, t) in enumerate(list(TEXTS.items()) * 12)]
    return spark.createDataFrame(data, "sample_id long, lang string, text string")


def test_kneser_ney_sums_to_one():
    m = _kn.Model(["ab ba abba", "a b ab"])
    letters = "ab "
    for before in ("", "a", "ab"):
        total = 0.0
        for c in letters:
            hashes, _ = _kn.word_hashes([before + c])
            total += np.exp(m.log_probs(hashes)[len(before)])
        assert total <= 1 + 1e-9 and total > 0.9 * (1 - 40 / m.alphabet)


def test_languages(spark, samples):
    en, de = TEXTS["en"], TEXTS["de"]
    docs = [
        (1, en, "EN-gb"), (2, de, "en"), (3, f"{en}. {en}. {de}.", "eng"), (4, None, "de"), (5, "", None), (6, "12 345 {6.7} →★", "en"), (7, "we know the library", None), (8, en + " " + " ".join(de.split()[:8]) + " " + en, "en"),
        (9, TEXTS["ru"].upper(), "??"), (10, de, " DEU "), (11, "c187H6+g6b/b3F5bDgC48G879AAD0b", "en"), (12, de.replace("ü", "ü"), "pl"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("scope", F.lit("clash"))
    assert rows(lang_labels.unnamed(df, samples), "doc_id", "lang") == [(2, "de"), (3, "de"), (7, "en"), (9, "ru"), (12, "de")]
    got = lang_labels.languages(df, samples).collect()
    whole = {r.doc_id: r for r in got if r.scope == "document"}
    assert len(whole) == len(docs) and whole[4].lang is None and whole[6].lang is None and whole[1].lang == "en"
    assert all(0 <= r.confidence <= 1 for r in got)
    three = [r for r in got if r.doc_id == 3 and r.scope == "passage"]
    assert [(r.lang, r.first_word) for r in sorted(three, key=lambda r: r.first_word)] == [("en", 0), ("de", 2 * len(en.split()))]
    assert lang_labels.unnamed(df.limit(0), samples).count() == 0


def test_held_out_accuracy(spark, samples):
    rng = random.Random(9)
    model, most = lang_labels.fit(samples)
    scorer = lang_labels.Scorer(model)
    texts = [(x, " ".join(rng.choices(t.split(), k=25))) for x, t in list(TEXTS.items()) * 30]
    got = lang_labels.label([t for _, t in texts], scorer, most)
    assert sum(g[0][3] == x for (x, _), g in zip(texts, got)) >= 0.97 * len(texts)
