import random

import numpy as np
import pytest

from symloom.llm import pii, pii_train
from symloom.llm.tagger import KINDS, TAGS, Tagger


@pytest.fixture(scope="module")
def tagger():
    return Tagger.load(pii.MODEL)


def kinds(tagger, text):
    return {(text[a:b], k) for a, b, k in pii.find_in(tagger, [text])[0]}


def test_gradient_is_right():
    tagger = Tagger.fresh(3, 2)
    tagger.w = {k: v.astype(np.float32) for k, v in tagger.w.items()}
    rng = np.random.default_rng(0)
    codes, tags = rng.integers(0, 90, (3, 6)).astype(np.uint8), rng.integers(0, len(TAGS), (3, 6)).astype(np.int8)
    _, grads = tagger.gradient(codes, tags, None)
    for name in ("u", "out", "move", "first", "bias", "x"):
        w = tagger.w[name].reshape(-1)
        spots = np.argsort(-np.abs(grads[name].reshape(-1)))[:3]
        for i in spots:
            old = w[i]
            w[i] = old + 1e-2
            up, _ = tagger.gradient(codes, tags, None)
            w[i] = old - 1e-2
            down, _ = tagger.gradient(codes, tags, None)
            w[i] = old
            assert abs((up - down) / 2e-2 - grads[name].reshape(-1)[i]) < 3e-2 * max(1, abs(grads[name].reshape(-1)[i]))


def test_decoding_is_the_best_sequence():
    import itertools

    tagger = Tagger.fresh(2, 1)
    rng = np.random.default_rng(3)
    tagger.w["move"] = rng.normal(size=tagger.w["move"].shape).astype(np.float32)
    tagger.w["first"] = rng.normal(size=len(TAGS)).astype(np.float32)
    scores = rng.normal(size=(3, 1, len(TAGS))).astype(np.float32)
    value = lambda s: tagger.w["first"][s[0]] + scores[0, 0, s[0]] + sum(tagger.w["move"][a, b] + scores[t + 1, 0, b] for t, (a, b) in enumerate(zip(s, s[1:])))
    best = max(itertools.product(range(len(TAGS)), repeat=3), key=value)
    assert tuple(tagger.decode(scores)[0]) == best


@pytest.mark.parametrize(
    "text,want",
    [
        ("Questions go to mailto:diego.skarinelli@tern.example.", {("diego.skarinelli@tern.example", "email")}),
        ("cc felix (at) post.test, thanks", None),
        ("If the queue is gone, ring +44 7700 900298 at once.", {("+44 7700 900298", "phone")}),
        ("Ticket text: my SSN is 959-30-4771, please correct it.", {("959-30-4771", "id_number")}),
        ("Her home address, 296 Lantern Road, Flat 22, Elkspire, sat in the fixture.", {("296 Lantern Road, Flat 22, Elkspire", "address")}),
        ("The pager went to Yusuf Quorströva, who found the cause.", {("Yusuf Quorströva", "person")}),
        ("Frau Warrberget prüft das.", {("Warrberget", "person")}),
        ("The Victor Mesh release replaced Ruby Grid in the edge.", set()),
        ("Clone it from git@repos.tern.example:offset/cursor.git first. Pin `lodestone@5.17.0` until then.", set()),
        ("Order 689-90-146301 was replayed. Build 2024-28-0506 ran on 10.250.77.228 port 8443 on 2024-07-15.", set()),
        ("Main Street of the pipeline is the queue, lane 6. Road map: 5 lanes.", set()),
        ("", set()),
    ],
)
def test_kinds(tagger, text, want):
    got = kinds(tagger, text)
    assert want is None or got == want


def test_held_out_accuracy(tagger, spark, data):
    """On documents that the tagger was not fitted on, against the labels of the trainer."""
    texts = [r.text for r in spark.read.parquet(f"{data}/../sf0.01/documents.parquet").filter("text is not null").select("text").collect()]
    names = pii_train.Names(texts, 1)
    same = seen = 0
    for text, spans in zip(texts, pii.find_in(tagger, texts)):
        want = {k for *_, k in pii_train.label(text, names)} - {"person"}
        got = {k for *_, k in spans} - {"person"}
        seen += len(want | got)
        same += len(want & got)
    assert seen > 100 and same / seen > 0.95


def test_windows_cover_stretches():
    rng = random.Random(1)
    for _ in range(50):
        a = rng.randrange(500)
        parts = [(a, a + rng.randint(1, 900))]
        ws = pii.cut(parts)
        assert ws[0][0] == a and ws[-1][1] == parts[0][1] and all(0 < y - x <= pii.WINDOW for x, y in ws)
        assert all(p[1] - q[0] == pii.OVERLAP for p, q in zip(ws, ws[1:]))


def covered(text, value):
    a = text.index(value)
    return any(x <= a and a + len(value) <= y for x, y in pii.stretches(text))


@pytest.mark.parametrize(
    "value",
    ["Jean DUPONT", "ANNA MUELLER", "Anna\nMueller", "Anna\u00a0Mueller", "Anna \r\n Mueller", "Anna_Mueller", "MUELLER, Anna", "Dr. Weber", "Mr. Smith", "J. Miller", "J. R. Miller", "Bei Ling", "M Weber", "Jean-Pierre O'Hara", "SSN: 12345", "passport number 1A2B3C4D5", "P.O.Box 1234567", "a" * 40 + "@b.example", "a" * 40 + " (at) b.example", "a@" + "b" * 40 + ".example", "12\nLantern Road"],
)
@pytest.mark.parametrize("before", ["", "See ", "Bei ", "With ", "As ", "The ", "when ", "_", "(", "-"])
def test_signs_are_necessary(value, before):
    assert covered("x " * 60 + before + value + ". and" + " x" * 60, value)


def test_stretches_cover_all_labels(spark):
    """Whatever the trainer can label is read: values of all its forms, and the labels of real documents."""
    rng = random.Random(5)
    first, last = ["Hana", "Owen", "Jean-Luc", "Zoë"], ["Tammaro", "Velkmoor", "O’Harran"]
    names = pii_train.Names([f"Regards, {a} {b}" for a in first for b in last] * 3)
    seen = {k: 0 for k in ("email", "phone", "id_number", "address", "person")}
    for n in range(3000):
        a, b, c, d = rng.choice(first), rng.choice(last), rng.choice(last), lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        title, sep = rng.choice(["Mr", "Dr.", "Frau", "Herrn", "Mme", "Señora", "M"]), rng.choice([", ", " ", "\n", "\r\n", ",\n"])
        value = rng.choice([
            f"{a} {b}", f"{a}_{b}", f"{a} K. {b}-{c}", f"{b}, {a}", f"{b.upper()}, {a} K.", f"{title} {b}", f"{title} K. {b}", f"K. {b}", f"{a.upper()} {b.upper()}", f"{a.lower()}.{d(9) * rng.randint(1, 5)}@mail.example", f"{a.lower()} (at) post [dot] example", f"x.{d(2)} at post.example", f"{a.lower()} at post dot example",
            f"+{d(2)} {d(4)} {d(6)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"0{d(2)}/{d(4)}", f"{d(3)}.{d(3)}.{d(4)}".replace(".", rng.choice("-. ")), f"SSN: {d(5)}", f"passport is {d(2)}A{d(2)}-B{d(1)}", f"tax ID = AB {d(2)} {d(2)} {d(2)} C",
            f"{d(3)} Lantern Road, Flat {d(2)}{sep}Elkspire", f"Elkspire, {d(1)} Old Lantern Ave.", f"{d(2)}, bis rue de la Tour{sep}{d(5)} Nanterre", f"Calle de la Luna {d(3)}", f"An der Mauer {d(2)}{sep}{d(5)} Bad Elk", f"Lindenstraße {d(3)}", f"P. O. Box {d(rng.randint(1, 8))}", f"P.O.Box {d(6)}{sep}Elkspire", f"Postfach {d(3)}",
        ])
        text = "it runs at night. " * 4 + rng.choice(["See ", "Bei ", "by ", "", "The ", "\n", "user="]) + value + rng.choice([" and", ".", "\n", ", "]) + " it runs" * 8
        parts = pii.stretches(text)
        for x, y, kind in pii_train.label(text, names):
            seen[kind] += 1
            assert any(p <= x and y <= q for p, q in parts), (kind, text[x:y], text)
    assert min(seen.values()) > 200
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null").select("text").collect()]
    names = pii_train.Names(texts, 1)
    for text in texts:
        parts = pii.stretches(text)
        assert all(any(p <= x and y <= q for p, q in parts) for x, y, _ in pii_train.label(text, names))


@pytest.mark.parametrize(
    "text,value",
    [("See Dr. Velkmoor about it.", "Velkmoor"), ("The report was written by Jean DUPONT last week.", "Jean DUPONT"), ("The pager went to ANNA MUELLER, who found it.", "ANNA MUELLER"), ("The pager went to Anna\u00a0Mueller, who found it.", "Anna\u00a0Mueller")],
)
def test_people_without_former_sign(tagger, text, value):
    assert (value, "person") in kinds(tagger, text)


def test_shouted_text_holds_no_names(tagger):
    assert not kinds(tagger, "LUMENAR REPLACED THEIR MATRIX WITH A MAGENTA STACK HOLDING 489 LEAVES. WHICH HEAP DOES THE TOKENIZER OF KATOPTRA USE")


def test_far_apart_and_in_long_texts(tagger):
    one = "Regards, Hana Tammukova\n"
    text = ("the queue drains at night. " * 40 + one) * 30
    assert [k for *_, k in pii.find_in(tagger, [text])[0]] == ["person"] * 30


def test_table(spark):
    rows = [(1, "Regards, Hana Tammukova", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (None, "Regards, Hana Tammukova", "x", 1), (4, "nothing here", "x", 1), (1, "Tel.: +33 1 99 00 57 75.", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_type string, first int")
    assert {(r.doc_id, r.pii_type) for r in pii.find(df).collect()} == {(1, "person"), (1, "phone")}
    red = sorted((r.doc_id, r.n_spans, r.redacted) for r in pii.redact(df).collect())
    assert red == [(1, 1, "Regards, [PERSON]"), (1, 1, "Tel.: [PHONE]."), (4, 0, "nothing here")]
    assert pii.find(df.limit(0)).count() == 0


def test_trainer_learns():
    """A few steps on labelled spans lower the loss by far (the shipped weights come from the same code)."""
    from symloom.llm.tagger import Adam

    rng = random.Random(4)
    texts = [f"Regards, {rng.choice(['Hana', 'Owen', 'Rosa'])} {rng.choice(['Tammaro', 'Velkmoor'])}\nand call +44 7700 900{rng.randint(100, 999)} now" for _ in range(120)]
    names = pii_train.Names(texts)
    data = [w for t in texts for w in pii_train.windows_of(t, pii_train.label(t, names))]
    length = max(len(c) for c, _ in data)
    codes, tags = np.full((len(data), length), 99, dtype=np.uint8), np.zeros((len(data), length), dtype=np.int8)
    for r, (c, t) in enumerate(data):
        codes[r, : len(c)], tags[r, : len(t)] = c, t
    assert (tags > 0).any()
    tagger = Tagger.fresh(12)
    adam = Adam(tagger.w, 0.02)
    losses = []
    for _ in range(40):
        loss, grads = tagger.gradient(codes, tags, None)
        adam.update(tagger.w, grads)
        losses.append(loss)
    assert losses[-1] < 0.25 * losses[0]


# Written by hand, in other words than the trainer's sentences: (text, what is in it).
HELD_OUT = [
    ("Yesterday Margaret Holloway signed the lease in person.", {("Margaret Holloway", "person")}),
    ("The nurse told Dr. Abernathy that the bed was free.", {("Abernathy", "person")}),
    ("You can write to margaret.h@lakeside.example about the keys.", {("margaret.h@lakeside.example", "email")}),
    ("Her number is (312) 555-0147, but she rarely picks up.", {("(312) 555-0147", "phone")}),
    ("Deliveries go to 48 Willow Lane, the green door.", {("48 Willow Lane", "address")}),
    ("SSN: 123-45-6789 was on the form.", {("123-45-6789", "id_number")}),
    ("Rückfragen an Frau Lindqvist oder telefonisch unter 030 5550198.", {("Lindqvist", "person"), ("030 5550198", "phone")}),
    ("Bitte an die Gartenstraße 14, 50667 Köln schicken.", {("Gartenstraße 14, 50667 Köln", "address")}),
    ("Nous avons reçu Mme Beaumont hier soir.", {("Beaumont", "person")}),
    ("Pregunte por Álvaro Quintana en la entrada.", {("Álvaro Quintana", "person")}),
    ("my name is jane doe and i live at 12 baker street", {("jane doe", "person"), ("12 baker street", "address")}),
    ("please ask mr henderson about it", {("henderson", "person")}),
    ("the meeting is with dr okonkwo at noon", {("okonkwo", "person")}),
    ("Сегодня Иван Петров подписал договор.", {("Иван Петров", "person")}),
    ("Ο Νίκος Παπαδάκης υπέγραψε σήμερα.", {("Νίκος Παπαδάκης", "person")}),
    ("Minutes by Jean\nDupont, sent on Friday.", {("Jean\nDupont", "person")}),
    ("See Dr. Weber about the scan.", {("Weber", "person")}),
    ("As J. Miller said, it was late.", {("J. Miller", "person")}),
    ("Ship to P.O. Box 771, Fairview.", {("P.O. Box 771, Fairview", "address")}),
    ("Ring +44 7700 900123 after six.", {("+44 7700 900123", "phone")}),
]
NOTHING = [
    "The Silver Bridge release went out on Monday with Green Valley as a fallback.", "Chapter 12 of the Field Guide lists 340 species.", "Build 20240715 took 1830 seconds on host-12.", "Ticket 4415882 was closed by the bot.", "Use the Main Street dashboard, lane 4.",
    "New Zealand and South Africa are in the list.", "The invoice total was 1,204,558.20 in March 2024.", "git@host.example:team/repo.git is the remote.", "Die Neue Fassung gilt ab Januar.", "the quick brown fox jumps over the lazy dog",
]


def test_held_out_sentences(tagger):
    """Sentences that nobody trained on: most of what is in them is found exactly, and little else."""
    want = [(n, *w) for n, (_, own) in enumerate(HELD_OUT) for w in own]
    got = [(n, v, k) for n, (text, _) in enumerate(HELD_OUT) for v, k in kinds(tagger, text)]
    loose = sum(any(n == m and k == j and (v in w or w in v) for m, w, j in got) for n, v, k in want)
    wrong = [(text, kinds(tagger, text)) for text in NOTHING if kinds(tagger, text)]
    print(loose, len(want), [w for w in want if w not in got], [g for g in got if g not in want], wrong)
    assert loose >= 0.85 * len(want) and sum(w in got for w in want) >= 0.75 * len(want)
    assert len(wrong) <= 2


def test_reading_whole_texts_finds_no_more(tagger, spark, data, monkeypatch):
    """The signs lose nothing: spans with them are those of windows over the whole text."""
    texts = [r.text for r in spark.read.parquet(f"{data}/../sf0.01/documents.parquet").filter("text is not null").orderBy("doc_id").limit(120).collect()] + [t for t, _ in HELD_OUT] + NOTHING
    signs = [{(k, texts[n][a:b]) for a, b, k in own} for n, own in enumerate(pii.find_in(tagger, texts))]
    monkeypatch.setattr(pii, "stretches", lambda text: [(0, len(text))])
    whole = [{(k, texts[n][a:b]) for a, b, k in own} for n, own in enumerate(pii.find_in(tagger, texts))]
    found = sum(map(len, whole))
    lost = [(n, w - s) for n, (s, w) in enumerate(zip(signs, whole)) if w - s]
    print(found, sum(map(len, signs)), lost)
    assert sum(len(x) for _, x in lost) <= max(1, found // 50)


def test_no_sequence_is_skipped_that_could_win(tagger):
    """Windows that are not searched, as O leads, have no better sequence."""
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 90, (400, 60)).astype(np.uint8)
    assert (tagger.tag(codes) == tagger.decode(tagger.emissions(codes))).all()
    wild = Tagger({k: v.copy() for k, v in tagger.w.items()})
    wild.w["move"] = rng.normal(size=wild.w["move"].shape).astype(np.float32) * 3
    assert (wild.tag(codes) == wild.decode(wild.emissions(codes))).all()


class Everything:
    """Tags all that it is given as one name."""

    def tag(self, codes):
        return np.full(codes.shape, 2 * KINDS.index("person") + 2, dtype=np.int8)


@pytest.mark.parametrize("text", ["x", "the queue drains at night, nothing else.\n", "the queue drains at night. " * 60, "王小明住在北京。" * 90, "12 " * 500])
def test_every_character_is_read(text):
    """Also of a text without a digit, a capital or an '@'."""
    assert pii.tag_texts(Everything(), [text, "", text]) == [[(0, len(text), "person")], [], [(0, len(text), "person")]]


def test_whole_texts_hold_no_more_than_their_labels(tagger, spark):
    """Code and prose without a sign of personal information give none."""
    texts = ["state.audit(buf)\n\tlog.Debug(\"hydrate partial route\", row, 250)\n\tkey := fmt.Sprint", "the release desk loses its stream to a volatile window, unless the gauge shrinks", "limits.replicas.forEach((x) => dst.align(x, 512));\n  const row = into", "it shrinks to 462 for input 161 while the tokenizer emits"]
    assert pii.find_in(tagger, texts) == [[]] * 4
    assert pii.find(spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")).count() == 0


def test_searched_places_are_enough(tagger):
    """What is searched between places that must be O gives the best sequence of the whole window, at its edges too."""

    class Given(Tagger):
        def emissions(self, codes):
            return self.scores

    rng = np.random.default_rng(7)
    seen = 0
    for n in range(60):
        own = Given({k: v.copy() for k, v in tagger.w.items()})
        if n % 2:
            own.w["move"] = rng.normal(size=own.w["move"].shape).astype(np.float32)
        own.scores = rng.normal(size=(int(rng.integers(1, 60)), 40, len(TAGS))).astype(np.float32) * 2
        own.scores[:, :, 0] += rng.choice([1, 3, 5, 6])
        want = own.decode(own.scores)
        seen += int((want > 0).any(axis=1).sum())
        assert (own.tag(np.zeros(want.shape, dtype=np.uint8)) == want).all()
    assert seen > 500


def test_both_ways_to_the_scores_agree(tagger):
    codes = np.random.default_rng(3).integers(0, 99, (30, 70)).astype(np.uint8)
    assert np.abs(tagger.emissions(codes) - tagger.forward(codes)[0]).max() < 1e-3


def test_a_character_costs_less_than_the_gates_of_an_lstm(tagger):
    """Scores take less time than exp and tanh alone would for two LSTMs of 44 units (less than half of what those took in all)."""
    import time

    codes = np.random.default_rng(5).integers(0, 95, (512, 96)).astype(np.uint8)
    gates, cells = np.zeros((2, 512, 176), dtype=np.float32), np.zeros((2, 512, 44), dtype=np.float32)

    def took(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    def plain():
        for _ in range(96):
            np.exp(gates + 0.3, out=gates)
            np.tanh(cells + 0.3, out=cells)
            gates.fill(0)

    assert min(took(lambda: tagger.emissions(codes)) for _ in range(5)) < min(took(plain) for _ in range(5))


@pytest.mark.parametrize("text,none", [("The Silver Harbor page links to North Macedonia.", True), ("Papers by Rosalind Pemberton, in two boxes.", False)])
def test_names_that_are_nobodys(tagger, text, none):
    assert (not kinds(tagger, text)) is none
