import random

from symloom.llm import leakage as k

WORDS = "the lexer of an ochre ring visits some nodes while its caller holds a leaf and parks every third one on heap before step".split()


def sentence(rng, n):
    return (" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))).capitalize() + "."


def setup(rng, n=30):
    intro = "Read the text with care, then answer what is asked."
    return [(100 + i, (intro + " " if i % 2 else "") + " ".join(sentence(rng, 14) for _ in range(4)), "t") for i in range(n)]


def changed(rng, words, every=7):
    out = list(words)
    for i in range(3, len(out) - 3, every):
        how = rng.randint(0, 2)
        if how == 0:
            out[i] = "other"
        elif how == 1:
            out[i] = out[i] + " really"
        else:
            out[i] = ""
    return [w for w in " ".join(out).split()]


def find(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    return {(r.doc_id, r.item_id) for r in k.leaks(df, spark.createDataFrame(items, "item_id long, text string, task string")).collect()}


def test_forms(spark):
    rng = random.Random(5)
    items = setup(rng)
    body = lambda i: items[i][1].split("asked. ")[-1]
    words = body(0).split()
    noise = lambda: " ".join(sentence(rng, 9) for _ in range(5))
    lines = "\n".join("> " + " ".join(words[i : i + 6]) for i in range(0, len(words), 6))
    numbered = "\n".join(f" {n}. " + " ".join(words[i : i + 6]) for n, i in enumerate(range(0, len(words), 6)))
    docs = [
        (1, noise() + "\n\n" + body(0) + "\n" + noise(), "a"),
        (2, body(0).upper(), "a"),
        (3, noise() + lines, "a"),
        (4, '{"prompt": "' + body(0).replace(". ", ".\\n ") + '", "label": 1}', "a"),
        (5, "**" + body(0).replace(" ", "   ", 9).replace(" the", " <b>the</b>") + "**", "a"),
        (6, " ".join(changed(rng, words)), "a"),
        (7, noise() + " ".join(words[10:33]) + noise(), "a"),  # over a third
        (8, noise() + " ".join(words[10:27]) + noise(), "a"),  # under a third
        (9, " ".join(words[:14]) + noise() + " ".join(words[30:44]), "a"),  # two short parts
        (10, "Read the text with care, then answer what is asked. " * 3, "a"),
        (11, " ".join(w for pair in zip(words, ["x"] * len(words)) for w in pair), "a"),  # every other word
        (12, None, "a"), (13, "", "a"), (None, body(0), "a"), (1, body(1), "a"), (14, numbered, "a"),
        (15, "filler " * 200_000 + body(2), "a"),
        (16, " ".join(reversed(words)), "a"),
    ]
    got = find(spark, docs, items + [(None, "x", "t"), (5000, None, "t"), (5001, "", "t"), items[0]])
    assert got == {(d, 100) for d in (1, 2, 3, 4, 5, 6, 7, 14)} | {(1, 101), (15, 102)}


def test_against_brute_force(spark):
    """Every pair of document and item by an alignment of all words, without seeds."""
    rng = random.Random(9)
    items = setup(rng, 12)
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(items))
            words = k.words(items[i][1])
            a = rng.randrange(len(words) - 20)
            piece = words[a : a + rng.randint(8, 60)]
            parts.append(" ".join(changed(rng, piece, rng.choice([7, 9, 100]))))
            parts.append(sentence(rng, 20))
        docs.append((d, " ".join(parts), "a"))
    counted = {r.item_id: r.words.split(" ") for r in k.item_words(spark.createDataFrame(items, "item_id long, text string, task string")).collect()}
    want = set()
    for d, text, _ in docs:
        codes: dict = {}
        left = [codes.setdefault(w, len(codes) + 1) for w in k.words(text)]
        for i, words in counted.items():
            best = k.stretch(left, [codes.get(w, -n - 1) for n, w in enumerate(words)])
            if best and best[0] >= len(words) * k.COVERAGE:
                want.add((d, i))
    assert want and find(spark, docs, items) == want


def test_tiles_cover_the_longest_first():
    a, b = [1, 2, 3, 4, 5, 9, 9, 6, 7, 8], [6, 7, 8, 0, 1, 2, 3, 4, 5]
    assert k.tiles(a, b) == [(0, 4, 5), (7, 0, 3)]
    assert k.tiles([], b) == [] and k.stretch([], []) is None


def test_short_items_and_blocks(spark, monkeypatch):
    items = [(1, "alpha beta", "t"), (2, "gamma", "t"), (3, "one two three four five six", "t")]
    docs = [(1, "so Alpha, beta it is", "a"), (2, "gamma alpha", "a"), (3, "one two three four five six seven", "a"), (4, "", "a")]
    want = {(1, 1), (2, 2), (3, 3)}
    assert find(spark, docs, items) == want
    monkeypatch.setattr(k, "BLOCK_WORDS", 2)
    assert find(spark, docs, items) == want
    assert find(spark, [], items) == set() and find(spark, docs, []) == set()


def test_seeds_lose_nothing_of_short_items():
    """Items of 4 to 40 words, a third or more of each in a document, edited as far as allowed: all are found."""
    rng = random.Random(6)
    for size in range(4, 41):
        item = [f"w{size}x{n}" for n in range(size)]
        block = k.Block([(1, " ".join(item))])
        for _ in range(40):
            m = rng.randint(-(-size // 3), size)
            a = rng.randint(0, size - m)
            part = item[a : a + m]
            edits = rng.randint(0, m // (k.EDIT_EVERY - 1))
            # additions only: all m words stay, between edits the runs are as the bound has them
            for at in sorted(rng.sample(range(1, m), min(edits, m - 1)), reverse=True):
                part.insert(at, "zz")
            found = list(block.scan(["pre " * 9 + " ".join(part) + " post" * 9]))
            want = k.stretch([0] * 9 + [item.index(w) + 1 if w in item else 0 for w in part], list(range(1, size + 1)), k.tiles([0] * 9 + [item.index(w) + 1 if w in item else 0 for w in part], list(range(1, size + 1)), min(k.MIN_TILE, k.seed_of(size))))
            if want and want[0] >= size * k.COVERAGE:
                assert found and found[0][2] == want[0], (size, part)
            if edits == 0:
                assert found and found[0][2] == m
    assert [k.seed_of(n) for n in (1, 3, 4, 6, 7, 9, 10, 12, 13, 18, 19, 60)] == [0, 0, 2, 2, 3, 3, 3, 3, 3, 3, 4, 4]


def test_reordered_passages(spark):
    """Three thirds of an item in another order: found by coverage only, and only if asked for."""
    item = [f"w{n}" for n in range(30)]
    texts = {1: " ".join(item[20:29] + item[10:19] + item[:9]), 2: " ".join(item), 3: " x y z u v w o p ".join(" ".join(item[a : a + 4]) for a in (8, 0, 20)), 4: " ".join(reversed(item))}
    docs = spark.createDataFrame([(d, f"before {t} after", "a") for d, t in texts.items()], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, " ".join(item), "t")], "item_id long, text string, task string")
    assert {(r.doc_id, r.in_order) for r in k.leaks(docs, items).collect()} == {(2, True)}
    found = k.leaks(docs, items, reordered=True)
    assert {(r.doc_id, r.in_order, r.matched_words) for r in found.collect()} == {(1, False, 27), (2, True, 30)}
    assert {(r.doc_id, r.n_items, r.n_reordered) for r in k.report(found).collect()} == {(1, 1, 1), (2, 1, 0)}


def test_a_weak_flank_hides_nothing():
    item = list(range(1, 91))
    core = []
    for n, w in enumerate(item[20:50]):
        core.append(w)
        if n % 5 == 4 and n < 28:
            core.append(0)  # 30 words with 5 additions
    alone = k.stretch(core, item)
    assert alone and alone[0] == 30
    flanked = item[13:16] + [0, 0] + core
    assert k.stretch(flanked, item)[0] >= 30


def test_tiles_equal_brute_force():
    """The longest match is always marked first."""
    rng = random.Random(8)
    for _ in range(200):
        a, b = [rng.randint(0, 4) for _ in range(rng.randint(0, 30))], [rng.randint(1, 4) for _ in range(rng.randint(0, 25))]
        found = k.tiles(a, b, 2)
        assert all(a[i : i + n] == b[j : j + n] and n >= 2 and 0 not in a[i : i + n] for i, j, n in found)
        assert len({x for i, _, n in found for x in range(i, i + n)}) == sum(n for *_, n in found) == len({x for _, j, n in found for x in range(j, j + n)})
        best = max((n for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n] and 0 not in a[i : i + n]), default=0)
        assert max((n for *_, n in found), default=0) == (best if best >= 2 else 0)
        # nothing is left that could be marked
        used = ({x for i, _, n in found for x in range(i, i + n)}, {x for _, j, n in found for x in range(j, j + n)})
        assert not any(a[i] and a[i : i + 2] == b[j : j + 2] and a[i + 1] and not used[0] & {i, i + 1} and not used[1] & {j, j + 1} for i in range(len(a) - 1) for j in range(len(b) - 1))
