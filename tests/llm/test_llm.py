"""Operators for training data: hand-made rows, brute force, exact round trips, held-out truth."""

import math
import random
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import bags, components, encoding, forms, mixing, mojibake, near_duplicates, overlaps, pairs, scans, splitting

TOKENIZERS = Path(encoding.BYTE_BPE).exists()


# ---- 3: groups


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("per_cell", [500_000, 7])
def test_groups_match_union_find(spark, per_cell):
    rng = random.Random(per_cell)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(999, i) for i in range(500, 540)]
    edges += [(None, 5), (5, None), (7, 7), edges[0], edges[0][::-1]]
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "src long, dst long, u string")
    got = {r.id: r.group_id for r in components.connected_groups(df, "src", "dst", edges_per_cell=per_cell).collect()}
    want = {k: v for k, v in union_find(edges).items()}
    assert got == want


def test_no_links_no_groups(spark):
    assert components.connected_groups(spark.createDataFrame([("a", None)], "x string, y string"), "x", "y").count() == 0


def test_duplicate_files(spark):
    side = "struct<claim_id:long,doc_id:string>"
    rows = [(" Duplicate", (1, "b"), (2, "a")), ("duplicate ", (1, "b"), (3, "c")), ("related", (1, "b"), (4, "d")), (None, (1, "b"), (4, "d")), ("duplicate", (1, "b"), None), ("duplicate", (1, "b"), (1, "b"))]
    df = spark.createDataFrame(rows, f"relation string, a {side}, b {side}")
    assert {tuple(r) for r in components.duplicate_files(df).collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


# ---- 4 and 5: similar bags


def sentence(rng, n):
    return [rng.choice("альфа бета гамма дельта епсилон".split()) if rng.random() < 0.5 else f"слово{rng.randrange(400)}" for _ in range(n)]


def claims(seed=1):
    rng = random.Random(seed)
    rows = []
    for f in range(60):
        base = sentence(rng, rng.randrange(8, 40))
        for _ in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(0, 2)] = sentence(rng, rng.randrange(0, 2))
            rng.random() < 0.5 and rng.shuffle(w)
            rows.append(" ".join(w))
    return rows + [None, "", "—", "коротко", rows[0], rows[0].upper()]


def brute_groups(texts, share=0.85, least=8):
    have = {i: Counter(bags.words(t)) for i, t in enumerate(texts) if t and len(bags.words(t)) >= least}
    edges = [(a, b) for a, b in combinations(have, 2) if (have[a] & have[b]).total() >= math.ceil(share * max(have[a].total(), have[b].total()) - 1e-9)]
    return union_find(edges)


def test_near_duplicates_match_brute_force(spark):
    texts = claims()
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, texts[0], 1)], "claim_id long, body string, n int")
    got = {r.claim_id: r.group_id for r in near_duplicates.near_duplicate_groups(df, "claim_id", "body").collect()}
    assert got == brute_groups(texts)


def test_large_family_under_one_key(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "DIRECT", 4)
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    base = [f"слово{i}" for i in range(30)]
    texts = [" ".join(base[:29] + [f"інше{k}"]) for k in range(40)] + [" ".join(f"друге{i}" for i in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.group_id for r in near_duplicates.near_duplicate_groups(df, "id", "t").collect()}
    assert got == {i: 0 for i in range(40)}


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates.near_duplicate_groups(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_sequential_bounds_keep_similar_pairs():
    rng, hashed, kept = random.Random(3), bags.Hasher(), 0
    for _ in range(300):
        a = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        b = a[:34] + [f"v{rng.randrange(10**6)}" for _ in range(6)]
        kept += int(near_duplicates.survives(near_duplicates.signature(hashed(a))[None], near_duplicates.signature(hashed(b))[None])[0])
    assert kept == 300


def test_bands_find_pairs_of_common_words_only():
    """Pairs at the threshold whose words are all among the 40 most common ones of any corpus."""
    rng, hashed, met = random.Random(7), bags.Hasher(), 0
    for _ in range(400):
        words = rng.sample(range(40), 26)
        a, b = [f"w{x}" for x in words[:20]], [f"w{x}" for x in words[3:23]]
        assert bags.overlap(a, b) == bags.common(20)
        sigs = near_duplicates.signatures(np.array(hashed(a) + hashed(b)), np.array([20, 20]))
        keys = near_duplicates.band_keys(sigs)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 0.93 * 400 and near_duplicates.band_recall(17 / 23) > 0.95


@pytest.mark.parametrize("copies", [1, 40])
def test_groups_do_not_depend_on_word_frequencies(spark, copies):
    """The same pairs come out when every word is made frequent by unrelated texts."""
    rng = random.Random(11)
    texts = claims(3)[:60]
    pool = sorted({w for t in texts for w in bags.words(t or "")})
    more = [" ".join(rng.sample(pool, 30)) for _ in range(copies * 10)]
    df = spark.createDataFrame(list(enumerate(texts + more)), "id long, t string")
    got = {r.id: r.group_id for r in near_duplicates.near_duplicate_groups(df, "id", "t").collect()}
    assert {k: v for k, v in got.items() if k < 60} == brute_groups(texts) and not any(k >= 60 for k in got)


def test_one_segment_is_always_found_among_the_substrings():
    rng = random.Random(12)
    for _ in range(2000):
        a = sorted(rng.sample(range(1000), rng.randrange(1, 60)))
        b = set(a)
        for _ in range(rng.randrange(0, 12)):
            rng.random() < 0.5 and b.discard(rng.choice(a))
            rng.random() < 0.5 and b.add(rng.randrange(1000))
        b = sorted(b)
        if not b or len(set(a) & set(b)) < bags.common(max(len(a), len(b))):
            continue
        parts = {tuple(a[p : p + n]): p for p, n in overlaps.segments(len(a))}
        assert sum(n for _, n in overlaps.segments(len(a))) == len(a)
        assert any(tuple(b[p : p + n]) in parts for p, n in overlaps.substrings(len(b)))


def test_split_overlaps_match_brute_force(spark):
    texts, rng = claims(5), random.Random(2)
    rows = [(f"i{k:03d}", rng.choice(["final", " Calibration", "tuning", "TUNING ", None, "dev"]), t, None if rng.random() < 0.3 else "відповідь одна", "x") for k, t in enumerate(texts)]
    rows += [rows[3], ("i900", "final", "Ｔhe sаme thing", None, "x"), ("i901", "tuning", "the same thing", None, "x"), (None, "final", "a b", "c", "x")]
    df = spark.createDataFrame(rows, "id string, split string, question string, reference_answer string, side string")
    got = {(r.eval_id, r.train_id) for r in overlaps.split_overlaps(df).collect()}
    bag = {}
    for i, s, q, a, _ in rows:
        if i and s and s.strip().lower() in ("final", "calibration", "tuning"):
            w = bags.words(forms.unify_texts(pa.array([q or "", a or ""]))[0][0].as_py() + "\n" + (a or ""))
            if w:
                bag[i] = (s.strip().lower() == "tuning", Counter(w))
    want = {(i, j) for i, (t, x) in bag.items() for j, (u, y) in bag.items() if not t and u and (x & y).total() >= math.ceil(0.85 * max(x.total(), y.total()) - 1e-9)}
    assert got == want and ("i900", "i901") in got


def test_banded_program():
    rng = random.Random(4)
    for _ in range(300):
        a, b = sorted(rng.randrange(20) for _ in range(rng.randrange(1, 15))), sorted(rng.randrange(20) for _ in range(rng.randrange(1, 15)))
        true = (Counter(a) & Counter(b)).total()
        need = bags.common(max(len(a), len(b)))
        got = overlaps.banded_common(a, b, need)
        assert (got >= need) == (true >= need) and (got < need or got == true)


# ---- 6: forms


@pytest.mark.parametrize(
    ("text", "want", "kinds"),
    [
        ("１２ Ａ？", "12 A?", forms.FULLWIDTH),
        ("край", "край", forms.ACCENT),
        ("о́ко", "о́ко", 0),
        ("до­говір﻿", "договір", forms.INVISIBLE),
        ("а б в", "а б в", forms.SPACE),
        ("дοгοвір", "договір", forms.LOOKALIKE),
        ("Щo caме y місті", "Що саме у місті", forms.LOOKALIKE),
        ("у розділі XXI, PDF і LLM-7B №5 … «так» – ’", "у розділі XXI, PDF і LLM-7B №5 … «так» – ’", 0),
        ("archіve оffice", "archive office", forms.LOOKALIKE),
        ("", "", 0),
        (None, None, 0),
    ],
)
def test_forms(text, want, kinds):
    got, flags = forms.unify_texts(pa.array([text], pa.string()))
    assert got.to_pylist() == [want] and flags.tolist() == [kinds]


def test_forms_keep_rows_apart_and_are_stable():
    rng = random.Random(1)
    chars = "абвіїйo aceiＡ１́̆​­ﬁα👩漢 \n"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(0, 30))) for _ in range(200)] + [None, "x" * 100_000]
    together = forms.unify_texts(pa.array(texts, pa.string()))[0].to_pylist()
    assert together == [forms.unify_texts(pa.array([t], pa.string()))[0][0].as_py() for t in texts]
    assert forms.unify_texts(pa.array(texts[3:9], pa.string()).slice(2, 3))[0].to_pylist() == together[5:8]


def test_consistent_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Ａ", "k"), (2, None, "k")], "id long, t string, t_kinds string")
    assert [tuple(r) for r in forms.consistent(df, ["t"]).orderBy("id").collect()] == [(1, "A", 1), (2, None, 0)]


# ---- 7: splitting


def test_pieces_cover_overlap_and_end_at_boundaries():
    rng = random.Random(9)
    for kind in range(30):
        unit = [" ".join("слово" * rng.randrange(1, 3) for _ in range(rng.randrange(3, 15))) + ". " for _ in range(rng.randrange(1, 400))]
        text = ("\n\n" if kind % 3 == 0 else "").join(unit) if kind % 5 else "x" * rng.randrange(1, 9000)
        spans = splitting.piece_spans(text)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 < e - s <= 1600 for s, e in spans)
        for (_, e), (s, _) in zip(spans, spans[1:]):
            assert 80 <= e - s <= 160
        if kind % 5:
            assert all(text[e - 1].isspace() for _, e in spans[:-1])


def test_split_items(spark):
    rows = [(1, "короткий", 5), (2, "a" * 1600, 5), (3, "слово " * 600, 5), (4, "", 5), (5, None, 5), (5, None, 5)]
    got = splitting.split_items(spark.createDataFrame(rows, "id long, t string, piece_no int"), "t").collect()
    text = dict((i, t) for i, t, _ in rows)
    assert Counter(r.id for r in got) == {1: 1, 2: 1, 3: len(splitting.piece_spans(text[3])), 4: 1}
    assert all(r.piece == text[r.id][r.char_start : r.char_end] for r in got)
    with pytest.raises(ValueError):
        splitting.split_items(spark.createDataFrame(rows, "id long, t string, piece_no int"), "t", 100, 100)


# ---- 8: encoding


@pytest.mark.skipif(not TOKENIZERS, reason="no tokenizers")
def test_ids_match_the_tokenizer_and_decode_back(spark):
    tiktoken = pytest.importorskip("tiktoken")
    coder = tiktoken.Encoding("t", pat_str=mixing._PATTERN, mergeable_ranks=encoding.read_ranks(encoding.BYTE_BPE), special_tokens={})
    rng = random.Random(0)
    texts = ["", None, " ", "\n\n  x", "Привіт, світ! I'll go <|endoftext|>", "ґанок їжак Об’єкт 2024", "漢字🙂 é́", "a" * 3000, "слово" * 500, "don't\t\tstop   "]
    texts += ["".join(rng.choice("абвгґіїщ xyzQ'19.,!\n\t—🙂é漢́") for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, ids int")
    got = encoding.encode(df, "doc_id", "text", frequent=20)
    rows = got.select("doc_id", "ids", encoding.decode(F.col("ids")).alias("back")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = "x" if r.doc_id is None else texts[r.doc_id] or ""
        assert list(r.ids) == coder.encode_ordinary(t) and r.back == t
    assert encoding.encode(df.limit(0), "doc_id", "text").count() == 0


# ---- 9: mixing


@pytest.mark.skipif(not TOKENIZERS, reason="no tokenizers")
def test_mix_meets_targets_within_a_document(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "слово і ще " * rng.randrange(0, 12)) for i in range(400)] + [(900, "b", None), (None, "b", "x y")]
    targets = [("m", "a", 0.5, 3, 0.4), ("m", "b", 0.3, 4, 0.4), ("m", "none", 0.1, 2, 0.4), ("m", "c", 0.1, 1, 0.4), ("n", "b", 1.0, 2, 5.0)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame(targets, "mix_id string, source string, target_share double, max_repeats int, total_ratio double")
    chosen, shares = mixing.mix(d, t)
    caps = {(m, s): r for m, s, _, r, _ in targets}
    picked = chosen.collect()
    assert all(0 < r.copies <= caps[r.mix_id, r.source] and r.doc_id is not None for r in picked)
    assert len({(r.mix_id, r.doc_id) for r in picked}) == len(picked)
    for r in shares.collect():
        if r.met and r.target_tokens:
            assert abs(r.actual_tokens - r.target_tokens) <= 150
        else:
            assert r.actual_tokens == r.available_tokens * r.max_repeats
    assert shares.where("mix_id = 'n'").first().met is False


# ---- 10: wrong decoding


@pytest.fixture(scope="module")
def model():
    rng = random.Random(8)
    words = "протягом робочих днів комітет розглядає оновлений перелік заявок товариство зберігає журнал після звірки щорічний з’їзд".split()
    text = "\n".join(" ".join(rng.choice(words) for _ in range(200)) for _ in range(200)) + " the committee reviews the list — “fine” isn’t it " * 100
    cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
    chars, n = np.unique(cp, return_counts=True)
    index = {int(c): k + 1 for k, c in enumerate(chars)}
    i = np.array([index[int(c)] for c in cp])
    size = len(chars) + 1
    return mojibake.Model(chars.astype(np.int64), np.bincount(i[:-1] * size + i[1:], minlength=size * size).reshape(size, size).astype(float))


@pytest.mark.parametrize("chain", [[("utf-8", "cp1251")], [("utf-8", "latin-1")], [("utf-8", "cp866")], [("cp1251", "latin-1")], [("cp1251", "koi8_u")], [("koi8_u", "cp1251")], [("cp1251", "cp866")], [("utf-8", "latin-1"), ("utf-8", "latin-1")]])
def test_garbled_runs_are_restored(model, chain):
    good = "комітет розглядає оновлений перелік заявок"
    bad = good
    for right, wrong in chain:
        bad = bad.encode(right).decode(wrong)
    text = f"протягом робочих днів {bad} товариство зберігає журнал"
    cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
    runs = mojibake.improbable_runs(model, cp, np.zeros(len(cp), int))
    new, n, lost = mojibake.restore_text(model, text, runs)
    assert n and not lost and new == f"протягом робочих днів {good} товариство зберігає журнал"


def test_clean_text_stays(model):
    for text in ("протягом робочих днів комітет", "╔══╗ 👩 漢字 …—«»", ""):
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        assert mojibake.restore_text(model, text, mojibake.improbable_runs(model, cp, np.zeros(len(cp), int)))[1] == 0


def test_garbled_rows(spark):
    good = "протягом робочих днів комітет розглядає перелік "
    rows = [(i, good * 20) for i in range(40)] + [(50, good.encode().decode("cp1251")), (51, "дні � робочих"), (52, None), (53, ""), (50, good.encode().decode("cp1251"))]
    got = mojibake.garbled(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert Counter(r.doc_id for r in got) == {50: 2, 51: 1}
    assert mojibake.garbled(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


@pytest.mark.parametrize(("right", "wrong"), [("utf-8", "cp1251"), ("utf-8", "cp1252"), ("cp1251", "cp1252"), ("cp1251", "koi8_u")])
def test_a_garbled_source_of_a_third_of_the_rows_is_found(spark, right, wrong):
    rng = random.Random(5)
    words = "протягом робочих днів комітет розглядає оновлений перелік заявок товариство зберігає журнал після звірки щорічний звіт Рівне Січень".split()
    good = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(600)]
    octets = [bytes([b]).decode(wrong, "ignore") or chr(b) for b in range(256)]
    rows = [(i, "".join(octets[b] for b in t.encode(right)) if i % 3 == 0 else t) for i, t in enumerate(good)]
    got = {r.doc_id: r.restored for r in mojibake.garbled(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {i: good[i] for i in range(0, 600, 3)}


# ---- 2: pairs

Q = "Протягом якого строку Комітет перевіряє реєстр скарг для товариства «Мурнало» згідно з наказом № 5851-д?"
S = "Згідно з наказом № 5851-д Комітет перевіряє реєстр скарг для товариства «Мурнало» протягом 44 робочих днів після передання справ."


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("Протягом 44 робочих днів після передання справ.", None), ("44 робочих днів", None), (S, None), ("Протягом 44 робочих днів (ст. 5)", None), ("протягом 44 робочих днів, формат PDF/A, Munsora API", None),
        (None, "empty"), ("…", "empty"), ("null", "empty"), ("​", "empty"), ("Відповідь:", "empty"),
        ("Протягом 44 робочих днів після пере", "truncated"), ("Протягом 44 робочих днів після", "truncated"), ("Протягом 44 робочих днів (зокрема", "truncated"), ("Протягом 44 робочих днів, а також", "truncated"), ("Протягом 44 робо…", "truncated"),
        ("На жаль, я не можу відповісти на це запитання.", "refusal"), ("I'm sorry, but I can’t help with that.", "refusal"), ("К сожалению, я не могу ответить на этот вопрос.", "refusal"),
        (Q, "copied_question"), (Q.lower().rstrip("?"), "copied_question"), ("Ви запитуєте: " + Q, "copied_question"), (Q + " " + Q, "copied_question"),
        ("The committee reviews the list within 44 working days.", "other_language"), ("Этот документ описывает, как учебный центр публикует сводный отчёт.", "other_language"), ("Das Archiv bewahrt die Verträge gemäß Anlage 25 für 3 Jahre auf.", "other_language"),
    ],
)
def test_defects(answer, want):
    assert pairs.defect_of(Q, answer, S) == want


@pytest.mark.parametrize(
    "answer",
    [
        "На превеликий жаль, я не маю змоги дати відповідь.", "Перепрошую, цього визначити неможливо: у документі немає про це жодних відомостей.", "Про це в тексті нічого не сказано, тому відповісти не можу.", "Бракує інформації.",
        "Sorry, the passage doesn't mention this.", "I am afraid I do not have enough context to say.", "That question is outside my area.", "It can't be determined from the text.",
        "Боюсь, что не располагаю такими сведениями.", "В документе об этом не говорится.", "Nie jestem w stanie udzielić odpowiedzi.", "Leider weiß ich es nicht.", "Je ne sais pas.", "Lo siento, no puedo contestar a eso.", "Desculpe, não consigo responder a essa pergunta.", "Mi dispiace, non posso rispondere a questa domanda.", "Bohužel na tuto otázku nelze odpovědět.", "Daarover is geen informatie beschikbaar.",
    ],
)
def test_refusals_that_no_template_has_word_for_word(answer):
    assert pairs.defect_of(Q, answer, S) == "refusal"


def test_an_answer_from_the_quote_is_no_refusal():
    quote = "Якщо даних недостатньо, комітет не може відповісти на запит і повертає його протягом 3 днів."
    assert pairs.defect_of("Що робить комітет?", "Комітет не може відповісти на запит і повертає його протягом 3 днів.", quote) is None


@pytest.mark.parametrize(("text", "want"), [("Les dossiers sont conservés par le service pendant trois ans.", "fr"), ("De commissie bewaart het register voor drie jaar.", "nl"), ("Komise schvaluje roční seznam spisů podle zákona.", "cs"), ("La commissione approva il registro dopo la verifica.", "it"), ("O comité aprova a lista depois da verificação.", "pt"), ("Der Ausschuss prüft den Bericht.", "de"), ("Komisja zatwierdza listę spraw.", "pl"), ("The board approves it.", "en"), ("Комісія затверджує перелік.", "uk"), ("Комиссия утверждает отчёты.", "ru")])
def test_language(text, want):
    assert pairs.language(text) == want


def test_defects_of_an_english_question():
    q, s = "Who rebuilds the index of Tarlin after the merger?", "After the merger the index of Tarlin is rebuilt by the Holbel archive office near Dav."
    assert pairs.defect_of(q, "The Holbel archive office near Dav.", s) is None
    assert pairs.defect_of(q, "Größere Abweichungen müssen vor der nächsten Sitzung erklärt werden.", s) == "other_language"
    assert pairs.defect_of(q, "The Holbel archive office near", s) == "truncated"
    assert pairs.defect_of(None, "Dav", None) is None


def test_defective_rows(spark):
    df = spark.createDataFrame([("a", Q, None, None, "z"), ("b", None, "так", None, "z"), ("a", Q, None, None, "z")], "id string, question string, reference_answer string, quote string, defect string")
    assert [tuple(r) for r in pairs.defective_pairs(df).collect()] == [("a", "empty")] * 2


# ---- 1: scans


def test_pages_are_repaired(spark):
    body = ["Комітет розглядає науково-технічний звіт і зберігає щорічний журнал заявок у місті.", "Товариство уточнює попередній перелік договірних справ протягом робочих днів."]
    clean = [(100 + i, f"clean{i}", 1, " ".join(body * 3)) for i in range(40)]
    noisy = [
        (1, "d", 1, "Комітет розглядає науково-\nтехнічний звіт і збе-\nрігає щорічний журнал заявок.\n\n- 11 -"),
        (2, "d", 2, "ПОРЯДОК ЗВІРКИ · ЧОБАЛИС\nТовариство уточнює попередній пере­\nлік договірннх справ\n\n- 12 -"),
        (3, "d", 3, "Порядок звірки · Чобалис\nпр0тягом робочих днів і збе¬\n\n- 13 -"),
        (4, "d", 4, "Порядок звіркн · Чобалис\r\nрігає журнал.\r\n\r\n- 14 -"),
        (5, "d", 5, None), (6, "d", 6, ""), (3, "d", 3, "Порядок звірки · Чобалис\nпр0тягом робочих днів і збе¬\n\n- 13 -"),
    ]
    df = spark.createDataFrame(noisy + clean, "page_id long, doc_id string, page int, text string")
    got = {r.page_id: r for r in scans.repair(df).collect()}
    assert got[1].noise == ["hyphenation", "page_number"] and got[1].text == "Комітет розглядає науково-технічний звіт і зберігає щорічний журнал заявок."
    assert got[2].noise == ["header", "hyphenation", "misread", "page_number"] and got[2].text == "Товариство уточнює попередній перелік договірних справ"
    assert got[3].noise == ["header", "hyphenation", "misread", "page_number"] and got[3].text == "протягом робочих днів і зберігає"
    assert got[4].noise == ["header", "page_number"]
    assert got[5].noise == got[6].noise == [] and got[5].text == ""
    assert all(not got[100 + i].noise for i in range(40))


def test_chapter_heads_and_numbers_that_start_anew(spark):
    heads = "Загальні положення;Порядок звітності;Облік документів;Строки зберігання;Права товариства;Робота комітету;Перелік заявок;Щорічна звірка;Склад комісії;Розгляд скарг;Зміни журналу;Прикінцеві норми".split(";")
    body = "протягом робочих днів комітет розглядає перелік"
    rows = [(i, "long", i + 1, f"{heads[i // 10]}\n\nрядок {body}\n{body} далі\nі ще {body}\n\n{i % 40 + 1}") for i in range(120)]
    got = {r.page_id: r.noise for r in scans.repair(spark.createDataFrame(rows, "page_id long, doc_id string, page int, text string")).collect()}
    assert got == {i: ["header", "page_number"] for i in range(120)}


def test_skip_grams_bring_words_of_like_context_together():
    rng = np.random.default_rng(0)
    ids = np.concatenate([[0, 2, 4] if x else [1, 3, 5] for x in rng.random(3000) < 0.5])
    counts = np.bincount(ids, minlength=6).astype(float)
    inner, outer = scans.local_skip_grams(scans.context_pairs(ids, 6), counts)
    assert (inner[0] @ outer[2]) > (inner[0] @ outer[3]) and (inner[1] @ outer[3]) > (inner[1] @ outer[2])


def test_vectors_decide_on_rare_dictionary_words():
    """A rare word of the dictionary is a misreading of a frequent one in like contexts only."""
    counts = {"вони": 900, "зони": 30, "комітет": 900, "комітег": 30}
    inner = np.array([[1, 0], [0, 1], [1, 1], [1, 0.8]], np.float32)
    words = scans.Words(counts, set(), inner, np.ones_like(inner))
    assert words.links("комітег") == ["комітет"] and words.links("зони") == []
    blind = scans.Words(counts, set(), np.zeros_like(inner), np.ones_like(inner))
    assert blind.links("комітег") == []


def test_pages_without_a_document_are_kept_apart(spark):
    body = "Комітет розглядає щорічний журнал заявок протягом робочих днів. " * 3
    rows = [(i, f"c{i}", 1, body) for i in range(30)] + [(100, None, 1, "Комітет роз-"), (101, None, 2, "глядає щорічний журнал"), (102, None, None, "журнал зая-"), (103, "d", None, "журнал зая-"), (104, "d", None, "вок\n\nдалі"), (None, "e", 1, "текст"), (None, "e", 1, "текст")]
    got = {r.page_id: r for r in scans.repair(spark.createDataFrame(rows, "page_id long, doc_id string, page int, text string")).collect() if r.page_id is not None}
    assert got[100].noise == [] and got[100].text == "Комітет роз-" and got[102].noise == []
    assert len(got) == 35 and got[100].doc_id is None


def test_pairs_of_two_stretches_add_up():
    rng = np.random.default_rng(3)
    a, b = (np.append(rng.integers(-1, 9, 400), [-1, -1]) for _ in range(2))
    key, n = scans.added_pairs(scans.context_pairs(a, 9), scans.context_pairs(b, 9))
    whole = scans.context_pairs(np.concatenate([a, b]), 9)
    assert (key == whole[0]).all() and (n == whole[1]).all()


def test_misreadings():
    assert scans.is_reading("технічннх", "технічних") and not scans.is_reading("технічних", "технічних") and not scans.is_reading("технічнох", "технічних")
    assert scans.plain_form("нав4альних") == "навчальних" and scans.plain_form("затверд>кує") == "затверджує" and scans.plain_form("арку|||ів") == "аркушів"
