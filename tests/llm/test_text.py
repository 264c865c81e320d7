"""Restoring, look-alikes, sentences and subjects on small corpora with known answers."""

import itertools
import random

import numpy as np
import pytest

from lexispark.llm import charlm, lookalikes, mojibake, sentences, subjects

JA = ["倉庫の鍵は{}が{}本とも持っている。", "きのう廊下の整理番号{1}を{0}が見落とした。", "{}は展望台で{}分ほど待っていた。", "担当は{}で、内線は{}番になる。"]
FR = ["{} préfère l’été où il a gagné {} points.", "M. {} a relu {} pages à l’étage."]
RU = ["В старом архиве {} нашёл {} ключей.", "Дверь {} осталась открыта {} минут."]
EN = ["Nobody told {} that the archive opens at {}.", "{} waited by the corridor for {} minutes."]
NAMES = ["ガルド", "ロクタ", "ベルサ", "ノルカ"], ["Varn", "Dressel", "Aubrey", "Quillis"], ["Белса", "Норка", "Гардо", "Томил"]


def lines(n, seed=0):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.choice("jjjfre")
        pool, names = {"j": (JA, NAMES[0]), "f": (FR, NAMES[1]), "r": (RU, NAMES[2]), "e": (EN, NAMES[1])}[kind]
        out.append(rng.choice(pool).format(rng.choice(names), rng.randrange(9999)))
    return out


DAMAGE = [("utf-8", "cp1252"), ("cp932", "mac_roman"), ("utf-8", "gb18030"), ("utf-8", "cp932"), ("cp1251", "koi8_r"), ("utf-8", "mac_roman"), ("cp1252", "cp1251")]


def damage(x, true, wrong):
    raw = x.encode(true)
    return raw.decode(wrong, "replace") if wrong in mojibake.WIDE else "".join(mojibake.TABLES[wrong][b] for b in raw)


def test_restores_damaged_lines(spark):
    clean = lines(4000)
    ruined = []
    for i, x in enumerate(lines(120, 9)):
        true, wrong = DAMAGE[i % len(DAMAGE)]
        try:
            y = damage(x, true, wrong)
        except UnicodeEncodeError:
            continue
        if y != x:
            ruined.append((f"d{i}", y if i % 3 else "今日は晴れ。\n" + y, x if i % 3 else "今日は晴れ。\n" + x))
    rows = [(f"c{i}", x, "k", 1.0) for i, x in enumerate(clean)] + [(i, y, "k", 1.0) for i, y, _ in ruined] + [(None, "ÃÂ©", "k", 1.0), ("n", None, "k", 1.0), ("e", "", "k", 1.0), ("f", "a�b", "k", 1.0)]
    posts = spark.createDataFrame(rows + rows[:5], "id string, content string, chain string, gain double")
    got = {r.rec_id: r for r in mojibake.restore(posts, None).collect()}
    hit = [i for i, *_ in ruined if i in got]
    wrong = [i for i in got if i and i.startswith("c")]
    kept = [(i, x) for i, y, x in ruined if i in got and "\ufffd" not in y]
    whole = sum(got[i].restored == x for i, x in kept)
    assert len(hit) >= 0.93 * len(ruined) and len(wrong) <= 3 and whole >= 0.8 * len(kept)
    assert got["f"].chain == "lost" and "n" not in got and "e" not in got


def test_cases_are_those_of_restore(spark):
    """Cases found without restoring them, and by a search that ends at the margin, are the same."""
    bad = []
    for i, x in enumerate(lines(160, 9)):
        true, wrong = DAMAGE[i % len(DAMAGE)]
        try:
            bad.append(damage(x, true, wrong) + ("\ufffd" if i % 11 == 0 else ""))
        except UnicodeEncodeError:
            continue
    rows = [(f"c{i}", x) for i, x in enumerate(lines(3000))] + [(f"d{i}", x) for i, x in enumerate(bad)] + [("f", "a\ufffdb"), ("n", None), ("e", ""), (None, "ÃÂ©")]
    posts = spark.createDataFrame(rows + rows[-9:], "id string, content string")
    want = {tuple(r) for r in mojibake.restore(posts, None).select("tbl", "rec_id").distinct().collect()}
    got = mojibake.cases(posts, None).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 80


def test_margin_is_looked_for_as_far_as_it_matters(spark):
    texts = lines(400, 7)
    table = np.zeros(charlm.SLOTS, dtype=np.int64)
    charlm.count(lines(3000, 1), table)
    shared = spark.sparkContext.broadcast(charlm.pack(table))
    held = spark.createDataFrame([(x,) for x in texts], "text string")
    far, near = mojibake._counted(held, shared, mojibake.STEPS), mojibake._counted(held, shared, mojibake.NEAR)
    low = mojibake.NEAR
    assert (far[:, :low] == near[:, :low]).all() and (far.sum(axis=1) == near.sum(axis=1)).all() and not near[:, low:-1].any() and far[1, low:-1].any()
    assert mojibake._settled(near, low) and mojibake._told_apart(near) == mojibake._told_apart(far) == mojibake._validated_margin(held, shared)
    # clean lines that gain more than the first steps: the best margin may lie beyond
    counts = np.zeros((2, mojibake.STEPS), dtype=np.int64)
    counts[0, 0], counts[0, -1], counts[1, -1] = 50, 50, 100
    assert not mojibake._settled(counts, low)


def test_restore_edges(spark):
    empty = spark.createDataFrame([], "id string, content string")
    none = spark.createDataFrame([], "line bigint, text string")
    assert mojibake.restore(empty, none).count() == 0
    big = spark.createDataFrame([("a", "きのう" * 200_000), ("b", "x" * 500_000)], "id string, content string")
    assert mojibake.restore(big, None).count() == 0


def test_double_damage_and_escapes():
    table = np.zeros(charlm.SLOTS, dtype=np.int64)
    charlm.count(lines(3000, 1), table)
    judge = mojibake.Restorer(charlm.Model(table))
    x = "倉庫の鍵はガルドが12本とも持っている。"
    twice = damage(damage(x, "utf-8", "cp1252"), "utf-8", "cp1252")
    iso = x.encode("iso2022_jp").decode().replace("\x1b", "")
    got = judge.restore([twice, iso, x, "ｶﾝﾊﾞﾝの文字が45か所だけ消えた", "Σ(ﾟДﾟ)"])
    assert got[0][0] == x and got[1][0] == x and [g[1] for g in got[2:]] == ["", "", ""]
    packed = charlm.unpack(charlm.pack(table))
    assert (packed == table).all()


def test_lookalike_pairs_against_all_pairs(spark):
    base = ["ハガキはロビーにある。No.12", "Aubrey said no on day 3", "т. е. Норка прав", "ガルドが待った か", "ガルドが待った が", "x²", "x2", "①", "1", "Case", "case", "ツ", "ッ"]
    twins = ["八ガキは口ビーにある。Νо.12", "Аubrеу sаid no​ on　day ３", "т. e. Hopкa пpaв", "ｶﾞﾙﾄﾞが待った か", "ガルドが待った か"]
    rows = [(f"p{i:02}", t, None, "k") for i, t in enumerate(base + twins)] + [("z1", None, None, "k"), ("z2", " 　", None, "k"), ("p00", base[0], None, "k")]
    posts = spark.createDataFrame(rows, "id string, content string, normalized string, ch string")
    got = {(r.id_a, r.id_b) for r in lookalikes.same_looking(posts).collect()}
    shape = lambda s: lookalikes.base(s).translate(lookalikes._SHAPED)
    texts = [(i, t) for i, t, *_ in rows if t and t.strip(" 　")]
    want = {(a, b) for (a, s), (b, t) in itertools.combinations(sorted(set(texts)), 2) if a < b and s != t and shape(s) == shape(t)}
    assert got == want and len(want) == 6
    forms = {r.id: r.form for r in lookalikes.normal_forms(posts).collect()}
    assert forms["p13"] == base[0] and forms["p14"] == base[1] and forms["p15"].startswith("т. ") and "z1" not in forms
    keys = {r.id: r.key for r in lookalikes.normal_forms(posts).collect()}
    assert keys["p13"] == keys["p00"] and keys["p15"] == keys["p02"]
    groups = {r.id: (r.class_id, r.spellings) for r in lookalikes.classes(posts).collect()}
    assert {(a, b) for a, b in itertools.combinations(sorted(groups), 2) if groups[a] == groups[b] and dict(rows_ := [(i, t) for i, t, *_ in rows])[a] != dict(rows_)[b]} == want
    assert lookalikes.same_looking(posts.limit(0)).count() == 0


def test_tokens_of_one_script_stay(spark):
    """Only tokens that mix scripts are repaired, and only into the vocabulary."""
    texts = ["二 人が来た", "力 が要る", "口 を開く", "へ 行く", "The оса said", "ΑΒΕ κ", "ニ ニ ニ", "カ カ カ", "ロ ロ", "oca oca", "pаge pаgе", "page"] + ["ニ", "カ", "ロ"]
    posts = spark.createDataFrame([(f"p{i:02}", t, None) for i, t in enumerate(texts)], "id string, content string, normalized string")
    forms = {r.id: r.form for r in lookalikes.normal_forms(posts).collect()}
    assert [forms[f"p{i:02}"] for i in range(len(texts))] == [*texts[:10], "page page", *texts[11:]]


def test_copies_make_no_pairs(spark):
    rows = [(f"a{i:04}", "同じ文", None) for i in range(3000)] + [("b", "同じ 文", None), ("c", "同じ 文", None)]
    posts = spark.createDataFrame(rows, "id string, content string, normalized string")
    assert [(r.id_a, r.id_b) for r in lookalikes.same_looking(posts).collect()] == [("b", "c")]


def joined(n, seed):
    """Texts of known sentences: (text, starts)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.choice("jjef")
        pool, names = {"j": (JA + ["「もう無理！帰る！」と{}が叫んで{}人が振り返った。"], NAMES[0]), "e": (EN + ["“Is page {1} finished?” {0} asked Dr. Varn."], NAMES[1]), "f": (FR, NAMES[1])}[kind]
        text, starts = "", []
        for k in range(rng.randint(1, 6)):
            if k:
                text += rng.choice(["", "", "\n"]) if kind == "j" else rng.choice([" ", " ", "\n"])
            starts.append(len(text))
            text += rng.choice(pool).format(rng.choice(names), rng.randrange(9999))
        out.append((text, starts))
    return out


def test_sentences_of_known_texts(spark):
    data = joined(900, 4)
    df = spark.createDataFrame([("t", str(i), x, 0, 1) for i, (x, _) in enumerate(data)], "tbl string, rec_id string, text string, starts int, z int")
    got = {}
    for r in sentences.split(df).collect():
        got.setdefault(int(r.rec_id), set()).add(r.start_at)
    want = {i: set(s) for i, (_, s) in enumerate(data)}
    tp = sum(len(got[i] & want[i]) for i in want)
    assert tp / sum(map(len, got.values())) > 0.98 and tp / sum(map(len, want.values())) > 0.98


def test_sentence_edges(spark):
    long = "あ。" * 50_000
    rows = [("t", "1", "  a\n\n b  "), ("t", "2", None), ("t", "3", ""), ("t", "4", " \n　"), ("t", "5", long), ("t", "6", "😀x\n​y"), (None, None, "q"), ("t", "1", "  a\n\n b  ")]
    got = sentences.split(spark.createDataFrame(rows, "tbl string, rec_id string, text string")).distinct().collect()
    by = {}
    for r in got:
        by.setdefault(r.rec_id, []).append((r.start_at, r.end_at))
    assert sorted(by["1"]) == [(2, 3), (6, 7)] and sorted(x for x, _ in by["6"]) == [0, 4] and by[None] == [(0, 1)] and not {"2", "3", "4"} & set(by)
    assert min(by["5"])[0] == 0 and max(by["5"])[1] == len(long)
    assert sentences.split(spark.createDataFrame([], "tbl string, rec_id string, text string")).count() == 0


TERMS = {"law": ["contract", "lawsuit", "hearing", "statute", "court"], "food": ["recipe", "garlic", "oven", "soup", "flour"], "sport": ["match", "goal", "coach", "league", "sprint"],
    "health": ["fever", "nurse", "surgery", "vaccine", "dose"], "money": ["loan", "share", "budget", "dividend", "tax"], "code": ["compiler", "merge", "script", "bug", "build"], "play": ["quest", "raid", "deck", "score", "guild"]}
FRAMES = ["The {} came before the {} in {} cases.", "{} and {} were compared {} times.", "Because of the {} the {} was late by {} days."]


def subject_corpus(n, seed):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        picked = rng.sample(sorted(TERMS), rng.choice([0, 1, 1, 1, 2]))
        s = [rng.choice(EN).format(rng.choice(NAMES[1]), rng.randrange(99)) for _ in range(rng.randint(2, 5))]
        for p in picked:
            s += [rng.choice(FRAMES).format(*rng.sample(TERMS[p], 2), rng.randrange(99)) for _ in range(rng.randint(2, 4))]
        rest = [p for p in TERMS if p not in picked]
        if rest and rng.random() < 0.3:  # mentioned in passing
            s.append(rng.choice(FRAMES).format(*rng.sample(TERMS[rng.choice(rest)], 2), rng.randrange(99)))
        rng.shuffle(s)
        docs.append((i, " ".join(s), 0.0, [0.0]))
        truth[i] = set(picked)
    return docs, truth


def test_subjects_of_unlabelled_documents(spark):
    docs, truth = subject_corpus(1200, 2)
    lab = [(i, s, "x") for i in range(200) for s in (sorted(truth[i]) or [None])] + [(5, None, "x"), (999_999, "law", "x"), (None, "law", "x")]
    d = spark.createDataFrame(docs + [(9001, None, 0.0, None), (9002, " ", 0.0, None), (9003, "", 0.0, None), docs[0]], "doc_id bigint, text string, second double, z array<double>")
    areas = spark.createDataFrame([(s, "t", "x") for s in [*TERMS, "unnamed"]], "subject string, title string, scope string")
    got = {}
    for r in subjects.classify(d, spark.createDataFrame(lab, "doc_id bigint, subject string, labelled_by string"), areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    rest = range(200, 1200)
    tp = sum(len(got.get(i, set()) & truth[i]) for i in rest)
    assert tp / sum(len(got.get(i, ())) for i in rest) > 0.9 and tp / sum(len(truth[i]) for i in rest) > 0.6
    assert not {9001, 9002, 9003} & set(got)


def test_subject_edges(spark):
    areas = spark.createDataFrame([("law", "t", "x")], "subject string, title string, scope string")
    d = spark.createDataFrame([(1, "a court")], "doc_id bigint, text string")
    lab = spark.createDataFrame([], "doc_id bigint, subject string, labelled_by string")
    assert subjects.classify(d, lab, areas).count() == 0
    lab = spark.createDataFrame([(1, None, "x")], "doc_id bigint, subject string, labelled_by string")
    assert subjects.classify(d, lab, areas).count() == 0 and subjects.classify(d.limit(0), lab, areas).count() == 0
    shares = subjects.composition(d, subjects.classify(d, lab, areas)).collect()
    assert [(r.subject, r.documents) for r in shares] == [(None, 1)]


@pytest.mark.parametrize("token,n", [("abc", 0), ("Вrаn", 3), ("口ビー", 1)])
def test_script_changes(token, n):
    assert lookalikes.mixing(token) == n


def test_sentence_starts_do_not_depend_on_partitions(spark):
    """One text, read after lines of one kind or of the other; rho comes from all lines, whatever a task reads first."""
    mixed = [" ".join(lines(2, i)) for i in range(300)]
    head = [x for i in range(40) for x in ("# " + str(i), "- item", "* x")]
    rows = [("t", str(i), x) for i, x in enumerate(head + mixed)]

    def run(order, parts):
        df = spark.createDataFrame(order, "tbl string, rec_id string, text string").coalesce(1) if parts == 1 else spark.createDataFrame(spark.sparkContext.parallelize(order, parts), "tbl string, rec_id string, text string")
        return sorted((r.rec_id, r.start_at) for r in sentences.split(df).collect())

    assert run(rows, 1) == run(rows, 40) == run(rows[::-1], 13)


def test_rho_is_the_median_over_all_lines(spark):
    texts = lines(500, 3) + ["- item"] * 200
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(9)
    model = sentences.load(sentences.fit(df).value)
    all_ = sentences.Lines(texts)
    ends = model.share(0, all_.closings(all_.last[all_.real] + 1), 0)
    starts = model.share(1, all_.openings(all_.first[all_.real]), 0)
    assert model.rho == pytest.approx((np.median(ends), np.median(starts)), abs=2 / sentences.BINS)


def test_held_out_lines_are_not_in_the_model():
    import pandas as pd

    clean = lines(2000, 5)
    out = pd.concat(mojibake._scan(iter([pd.DataFrame({"tbl": "posts", "rec_id": [str(i) for i in range(len(clean))], "text": clean})])))
    held = set(out[out["kind"] == "h"]["text"])
    assert 0 < len(held) < 0.1 * len(clean)
    got = out[out["kind"] == "c"].iloc[0]
    table = np.zeros(charlm.SLOTS, dtype=np.int64)
    charlm.count([x for x in clean if x not in held], table)
    assert (np.flatnonzero(table) == got["slots"]).all() and (table[got["slots"]] == got["counts"]).all()


def test_margin_comes_from_all_held_lines(spark):
    """The margin is the same in any order of the rows, and every family damages some lines."""
    texts = lines(600, 7)
    table = np.zeros(charlm.SLOTS, dtype=np.int64)
    charlm.count(lines(3000, 1), table)
    shared = spark.sparkContext.broadcast(charlm.pack(table))
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    margins = {mojibake._validated_margin(df.repartition(n), shared) for n in (1, 7)}
    assert len(margins) == 1 and margins.pop() >= mojibake.MARGIN
    assert {f for x in texts for f, _ in mojibake.hurt(x)} == set(mojibake.FAMILIES)
    counts = np.zeros((2, mojibake.STEPS), dtype=np.int64)
    counts[0, 0], counts[0, 47], counts[1, 200] = 90, 10, 100  # clean lines gain up to 12
    assert mojibake._told_apart(counts) == 12.0


def trained(texts):
    table = np.zeros(charlm.SLOTS, dtype=np.int64)
    charlm.count(texts, table)
    return charlm.Model(table)


def test_thinly_spread_damage_is_scored():
    """Single letters swapped in separate words, none of them striking by itself, gain above the margin in sum."""
    judge = mojibake.Restorer(trained(lines(3000, 1) + ["Le café est fermé."] * 50))
    scores = judge.model._of
    # every swapped letter is a little unlikely, no six characters in a row are very unlikely
    judge.model._of = lambda a: np.where(a[2:] == ord("й"), -6.0, np.maximum(scores(a), -4.0))
    x = " ".join(["fermé aaaaa"] * 12)
    assert judge.best([x.replace("é", "й")])[0][2] == x


def test_stretch_and_word_chains_compete():
    """Of all chains beyond the margin the likeliest is taken, whatever its family."""
    judge = mojibake.Restorer(trained(lines(3000, 1)))
    by = {"cp1252>cp932": [(20.0, 0, 4, "weak")], "cp1252>cp1251": [(30.0, 0, 2, "wo"), (26.0, 2, 4, "rd")]}
    assert judge._take("éèéè", by) == (56.0, "cp1252>cp1251", "word")
    assert judge._take("éèéè", {"cp1252>cp932": [(8.0, 0, 4, "weak")]}) is None


def test_search_against_every_single_decoding():
    """The gains of chains from readings of more bytes, against encoding and decoding each pair of encodings by itself."""
    model = trained(lines(3000, 1) + [ZH, KO] * 50)
    pairs = [(ZH, "gb18030", "cp932"), (KO, "cp949", "cp932"), (JA[0], "cp932", "cp949"), (JA[1], "cp932", "gb18030"), (RU[0], "cp1251", "gb18030"), (RU[1], "koi8_r", "big5")]
    bad = [x[a : a + 9].encode(t).decode(w, "replace") for x, t, w in pairs for a in range(20)]
    texts = [x for x in bad if x and not x.isascii() and "\n" not in x and mojibake.LOST not in x and len(mojibake.PIECE.match(x)[0]) == len(x) >= 4]
    got = mojibake._Search(model, -1e9, texts)
    assert len(got.open) >= 10
    for x, gains in zip(got.texts, got.gains):
        for w in mojibake.WIDE:
            for t in (*mojibake.TRUE_WIDE, *mojibake.TRUE_NARROW):
                if t == w:
                    continue
                try:
                    raw = x.encode(w)
                except UnicodeEncodeError:
                    continue
                y = raw.decode(t, "replace") if t in mojibake.TRUE_WIDE else "".join(mojibake.TABLES[t][b] for b in raw)
                sums, _ = model.totals([x, y])
                fits = not mojibake.IMPLAUSIBLE.search(y) if t in mojibake.TRUE_NARROW else y.count(mojibake.LOST) * 6 <= sum(c > "\x7f" for c in y)
                want = sums[1] - sums[0] if fits and y != x and sums[1] > sums[0] else None
                have = sum(g for g, *_ in gains[f"{w}>{t}"]) if f"{w}>{t}" in gains else None
                assert abs((want or 0.0) - (have or 0.0)) < 0.05


ZH, KO = "他昨天在图书馆门口等了很久，后来才知道会议已经取消了。", "어제 도서관 앞에서 오래 기다렸지만 회의는 취소되었다고 한다."


@pytest.mark.parametrize("text,true,wrong", [(ZH, "gb18030", "cp932"), (KO, "cp949", "cp932"), (JA[0], "cp932", "cp949"), ("когда зима", "utf-8", "euc_jp"), (RU[0], "cp1251", "gb18030"), (RU[1], "cp1251", "cp1253"), (RU[1], "koi8_r", "cp874")])
@pytest.mark.parametrize("head", ["", "きのうは晴れていた。\n"])
def test_every_pair_has_a_candidate(text, true, wrong, head):
    """Also where a part of the text is clean and fits another encoding."""
    raw = text.encode(true)
    bad = raw.decode(wrong, "replace") if wrong in mojibake.WIDE else "".join(mojibake.TABLES[wrong][b] for b in raw)
    x = head + bad
    gains = mojibake._Search(trained([text] * 50 + ["きのうは晴れていた。"] * 50), -1e9, [x]).gains
    assert bad != text and mojibake.suspicion(x) and f"{wrong}>{true}" in {n.removesuffix(":2") for n in gains[0]}


def test_chains_into_one_byte_drop_no_characters():
    x = "､ｽ､ﾎｷ�､ﾊ､�2678ﾈﾖﾌﾜ､ﾎｽ"  # half-width kana are not in cp949
    gains = mojibake._Search(trained(lines(3000, 1)), -1e9, [x]).gains[0]
    assert not [n for n in gains if n.startswith("cp949>") and n.split(">")[1] in mojibake.TRUE_NARROW]


def test_word_is_judged_between_its_neighbours():
    """A Thai letter that opens many lines is no reading of a French word in the middle of one."""
    gains = mojibake._Search(trained(["il a dit non à Paul"] * 50 + ["เ ก"] * 500), -1e9, ["il a dit non à Paul"]).gains
    assert gains in ([], [{}])


def test_a_text_is_judged_alike_in_any_company():
    """Results do not depend on which texts are searched together, on breaks inside them or on their order."""
    judge = mojibake.Restorer(trained(lines(3000, 1) + [ZH, KO] * 20))
    texts = [JA[0].encode().decode("cp1252", "ignore"), "a\n\nb\n" + RU[0].encode("cp1251").decode("koi8_r"), ZH.encode("gb18030").decode("cp932", "replace") + "\n\n\n", FR[0], "\n", "�", "x�é", EN[0], "😀" + JA[1].encode().decode("gb18030", "replace")]
    alone = [judge.restore([t])[0] for t in texts]
    assert [a[:2] for a in judge.restore(texts)] == [a[:2] for a in alone]
    assert [a[:2] for a in judge.restore(texts[::-1])] == [a[:2] for a in alone[::-1]]
    assert sum(bool(a[1]) for a in alone) >= 3


def test_spans_reach_back_as_far_as_it_scores():
    """Against the best of all choices of starts, on a line longer than 4,000 characters."""
    model = sentences.Model(np.zeros(sentences.SLOTS, dtype=np.int64))
    model.mean, model.std = np.log(9000.0), 0.5
    places = [(0, 0.0, 0), (100, -0.1, 0), (4500, -0.1, 0), (9000, 0.0, 0)]

    def worth(inner):
        at = [places[0], *inner, places[-1]]
        return sum(b[1] + model.length(b[0] - a[0]) for a, b in zip(at, at[1:]))

    choices = [c for k in range(3) for c in itertools.combinations(places[1:-1], k)]
    assert sentences._best_spans(places, model) == [p[0] for p in max(choices, key=worth)] == []
    rng = random.Random(3)
    for _ in range(300):
        model.mean = np.log(rng.choice([30.0, 600.0, 6000.0]))
        offsets = sorted(rng.sample(range(1, 9000), 7))
        places = [(0, 0.0, 0), *[(o, rng.uniform(-9, 9), 0) for o in offsets], (9001, 0.0, 0)]
        choices = [c for k in range(8) for c in itertools.combinations(places[1:-1], k)]
        got = [p for p in places[1:-1] if p[0] in set(sentences._best_spans(places, model))]
        assert worth(got) == pytest.approx(max(map(worth, choices)))


ODD = ["", "plain", "a ~{VPND~} b", "+AGEAYgBj-", "été “x”", "“x”", "ﾊﾝｶｸ", "漢字", "한글", "\x85", "\x81", "�", "Ã©tÃ©", "ÎºÎ±Î¹ ÏƒÎ¿Ï†Î¯Î±", "𝟎 x", "１２ ３", "Ã¦â€\x9d Â½Â² ÃÃÃÃ"]


def test_p4_lines_are_searched_without_levels(monkeypatch):
    texts = [*ODD, *lines(40), *(y for x in lines(40) for _, y in mojibake.hurt(x))]
    assert [mojibake.searched(x) for x in texts] == [v > 0 for v in mojibake.suspicions(texts)]
    table = np.zeros(charlm.SLOTS, dtype=np.int64)
    charlm.count(lines(400), table)
    monkeypatch.setattr(mojibake, "suspicions", None)
    gains = mojibake._gains(mojibake.Restorer(charlm.Model(table), 0.0), texts, mojibake.NEAR)
    assert len(gains) == len(texts) and max(gains) > mojibake.NEAR * mojibake.STEP and gains[0] == gains[1] == 0.0


def test_p4_damage_and_density_as_said_by_character():
    for x in [*ODD, *lines(60)]:
        for _, y in mojibake.hurt(x):
            high = sum(c > "\x7f" for c in y)
            solid, signs = sum(not c.isspace() and not c.isdigit() for c in y), sum("\x80" <= c <= "ǿ" or "‐" <= c <= "◿" for c in y)
            assert mojibake._dense(y) == (high >= 6 and high * 5 >= 2 * solid and signs * 5 >= 4 * high)
        for true, wrong in (("cp1251", "cp1252"), ("cp1253", "cp437"), ("cp874", "mac_roman")):
            if all(c < "\x80" or c in mojibake.BYTE_OF[true] for c in x):
                assert mojibake._misread(x, true, wrong) == "".join(mojibake.TABLES[wrong][mojibake.BYTE_OF[true][c] if c > "\x7f" else ord(c)] for c in x)


def test_p4_starts_as_said_by_match():
    for s in ["a.b c!d 3.14です。次。\n", ">>0。次 >>12-34 漢字 です\n", "見て>>0 と言う。>>0  漢字。\n", "x.y!Z。w.w ~a\n", "「あ。」い (笑)う ww え\n", "\n"]:
        x = sentences.Lines([s])
        want = []
        for m in sentences.CANDIDATE.finditer(x.s):
            i, j = m.span()
            low = lambda c: c in "abcdefghijklmnopqrstuvwxyz0123456789=/&_-@%+#"
            if i == j or x.s[j - 1] == " ":
                part = x.s[max(0, i - 12) : j]
                ok = not (">>" in part and sentences.ANCHOR.search(part))
            else:
                ok = not (low(x.s[j]) and (i == 0 or low(x.s[i - 1])) and x.s[j - 1] in ".!?~")
            want += [j] * ok
        assert x._starts(x.s).tolist() == want
