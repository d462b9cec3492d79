import random

from pliego.llm import leaks

VOCAB = [f"palabra{i}" for i in range(400)]


def passage(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def brute(item, text):
    """Whether 20 successive words (or the whole passage) stand in the text with at most one word in ten replaced."""
    a, b = leaks.words(item), leaks.words(text)
    need = min(20, len(a))
    for i in range(len(a) - need + 1):
        for j in range(len(b) - need + 1):
            if sum(x != y for x, y in zip(a[i : i + need], b[j : j + need])) <= need // 10:
                return True
    return False


def find(search, text):
    return sorted(search.keys[slot] for _, slot, _ in search.find([text]))


def test_against_brute_force():
    rng = random.Random(3)
    items = [(i, passage(rng, rng.choice([3, 9, 14, 30, 60]))) for i in range(40)]
    search = leaks.Search(items)
    for _ in range(150):
        key, item = rng.choice(items)
        ws = item.split()
        n = rng.choice([len(ws), min(len(ws), 20), min(len(ws), 15), min(len(ws), 26)])
        start = rng.randint(0, len(ws) - n)
        part = ws[start : start + n]
        text = passage(rng, 30) + " " + " ".join(part) + " " + passage(rng, 30)
        assert (key in find(search, text.upper())) == brute(item, text)


def test_replaced_words_and_accents():
    rng = random.Random(4)
    item = passage(rng, 60)
    search = leaks.Search([(7, item)])
    ws = item.split()
    for i in range(5, 60, 11):
        ws[i] = "otra"
    assert find(search, "Él dijo: «" + ", ".join(ws).replace("a", "á") + "»") == [7]
    for i in range(0, 60, 4):
        ws[i] = "otra"
    assert find(search, " ".join(ws)) == []


def test_broken_passage():
    rng = random.Random(5)
    ws = passage(rng, 31).split()
    search = leaks.Search([(1, " ".join(ws))])
    assert find(search, " ".join(ws[:18]) + " " + passage(rng, 40) + " " + " ".join(ws[18:])) == [1]
    assert find(search, " ".join(ws[:9]) + " " + passage(rng, 40) + " " + " ".join(ws[9:18])) == []


def test_short_stretches_with_replaced_words(spark):
    """Stretches of 20 to 29 words with one and two replaced, and passages broken anywhere, beside texts that hold none."""
    rng, rows, want = random.Random(8), [], set()
    items = [(i, passage(rng, 60)) for i in range(40)]
    for i in range(400):
        key, item = rng.choice(items[30:] if i % 4 == 3 else items[:30])
        n, ws = rng.randint(20, 29), item.split()
        start, doc = rng.randint(0, 60 - n), len(rows)
        part = ws[start : start + n]
        kind = i % 4
        if kind < 2:
            for at in rng.sample(range(2, n - 2), kind + 1):
                part[at] = f"otra{i}"
            text = passage(rng, 20) + " " + " ".join(part) + " " + passage(rng, 20)
        elif kind == 2:
            cut = rng.randint(6, n - 6)
            text = " ".join(part[:cut]) + " " + passage(rng, 30) + " " + " ".join(part[cut:])
        else:
            text = passage(rng, 15) + " " + " ".join(part[:15]) + " " + passage(rng, 15)
        rows.append((doc, text))
        if kind != 3:
            want.add((doc, key))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in leaks.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want & got) / len(want) >= 0.98 and got <= want


def test_turns_of_phrase_are_no_leaks(spark):
    """Two short runs that many texts share, chained by another word, prove nothing; the same with runs of one's own do."""
    rng = random.Random(9)
    a, b, own = passage(rng, 12), passage(rng, 11), passage(rng, 24).split()
    items = [(1, f"{a} uno {b}"), (2, " ".join(own))]
    rows = [(i, f"{passage(rng, 9)} {x}") for i in range(300) for x in [f"{a} otro{i} {passage(rng, 5)}" if i % 2 else f"{passage(rng, 5)} otro{i} {b}"]]
    own[11] = "otra"
    rows += [(900, f"{a} dos {b}"), (901, " ".join(own))]
    got = [tuple(r) for r in leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert got == [(901, 2)]


def test_lanes_and_batches_agree():
    rng = random.Random(10)
    items = [(i, passage(rng, rng.choice([12, 40]))) for i in range(20)]
    search = leaks.Search(items)
    texts = [" ".join([passage(rng, rng.randint(0, 90)), rng.choice(items)[1], passage(rng, rng.randint(0, 90))]) for _ in range(60)]
    together = sorted((o, s) for o, s, _ in search.find(texts))
    assert together == sorted((i, s) for i, t in enumerate(texts) for _, s, _ in search.find([t]))


def test_tables(spark):
    rng = random.Random(6)
    item = passage(rng, 40)
    docs = spark.createDataFrame([(1, item, 1), (1, item, 1), (2, None, 1), (3, "", 1), (4, "¿?", 1), (5, "x" * 200_000, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, item), (11, None), (12, "..."), (10, item)], "item_id long, text string")
    assert [tuple(r) for r in leaks.find_leaks(docs, items).collect()] == [(1, 10)]
    assert leaks.find_leaks(docs.limit(0), items).count() == 0
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0
