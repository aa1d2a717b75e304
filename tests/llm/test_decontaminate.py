import re

from quarrylight.llm import decontaminate as D

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    raw = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    out, prev_end, prev = [], None, None
    for m in WORD.finditer(low):
        word = m[0].decode(errors="replace")
        first = raw[m.start() : m.start() + 1]
        if m[0].isdigit():
            kind = "N"
        elif prev == "N" and word in D.UNITS:
            kind = "U"
        elif prev_end is not None and b"A" <= first <= b"Z" and not re.search(rb"[.!?:\n]", raw[prev_end : m.start()]):
            kind = "A"
        else:
            kind = word
        out.append((kind, word))
        prev_end, prev = m.end(), kind
    return out


def windows(toks):
    out = {}
    for size in range(D.MIN_LITERAL, D.WINDOW + 1):
        for s in range(len(toks) - size + 1):
            win = toks[s : s + size]
            if sum(k not in ("N", "U", "A") for k, _ in win) >= min(D.MIN_LITERAL, size):
                out.setdefault(tuple(k for k, _ in win), []).append((s, [w for k, w in win if k in ("N", "U", "A")]))
    return out


def brute(docs, items):
    out = {i: set() for i, _ in docs}
    wanted = {}
    for item, text in items:
        toks = tokens(text)
        wins = {k: v for k, v in windows(toks).items() if len(k) == D.WINDOW or len(k) == len(toks)}
        wanted[item] = (wins, len({s for v in wins.values() for s, _ in v}))
    for i, text in docs:
        have = windows(tokens(text))
        for item, (wins, n) in wanted.items():
            placed = {}
            for k, places in wins.items():
                for s, a in places:
                    for t, b in have.get(k, []):
                        at, pairs = placed.setdefault(t - s, (set(), set()))
                        at.add(s)
                        pairs |= set(zip(a, b, strict=True))
            for at, pairs in placed.values():
                if len(at) >= min(D.NEED, n) and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                    out[i].add(item)
    return out


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.decontaminate(d, b).collect()
    assert len(got) == len(docs)
    want = brute(docs, items)
    assert {r["doc_id"]: set(r["item_ids"]) for r in got} == want
    assert all(r["contaminated"] == bool(want[r["doc_id"]]) for r in got)


QUESTION = "A train leaves for Paris at a speed of 60 km and later meets another at 60 km while a walker covers 5 miles before noon"


def test_reparameterised_questions(spark):
    filler = "some words before it. "
    docs = [
        (1, filler + QUESTION),
        (2, filler + QUESTION.replace("60", "75").replace("5 miles", "9 miles").replace("Paris", "Lyon")),
        (3, filler + QUESTION.replace("60 km and", "75 km and")),
        (4, "nothing here"), (5, None), (6, ""), (7, "short item with five"), (8, (QUESTION + ". ") * 400), (9, "a " * 100_000),
    ]
    items = [(10, QUESTION), (11, "short item with five"), (12, "one two"), (13, None), (14, "")]
    check(spark, docs, items)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r["doc_id"] for r in D.decontaminate(d, spark.createDataFrame(items, "item_id long, text string")).collect() if r["contaminated"]}
    assert found == {1, 2, 7, 8}


def test_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    check(spark, docs, items)


def test_empty(spark):
    d, b = (spark.createDataFrame([], f"{n}_id long, text string") for n in ("doc", "item"))
    assert D.decontaminate(d, b).collect() == []


def test_verbatim_copies_of_any_item(spark):
    items = [
        (1, "Zugspitze"), (2, "one two"), (3, "What is 17 + 25 * 3 - 4?"), (4, "NAME THE LARGEST PLANET OF THE SOLAR SYSTEM"),
        (5, "Which Of These Cities Is The Capital Of France: Paris, Lyon, Nice"), (6, "水の沸点は何度ですか。"), (7, "中国的首都是哪个城市"), (8, "What colour is grass today"), (9, "สวัสดีครับ"), (10, "12 * 7"),
    ]
    docs = [(i, f"so they asked, and then {t} was written down") for i, t in items if i not in (6, 7, 9)]
    docs += [(6, "問題、水の沸点は何度ですか。答えは百度です"), (7, "请问中国的首都是哪个城市呢abc"), (9, "กขสวัสดีครับคง")]
    docs += [(100, "What is 17 - 25 * 3 + 4?"), (101, "水の沸点は何度でした"), (102, "one, three, two"), (103, "12 * 8"), (104, ""), (105, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["item_ids"] for r in D.decontaminate(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: [i] if i < 100 else [] for i, _ in docs}
