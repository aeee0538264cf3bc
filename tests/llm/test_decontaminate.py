"""Decontamination: verbatim passages in any case and place, partly changed copies, and short or number-only items."""

from tallyspark.llm import decontaminate

ITEM = "Alice bought 5 apples for 3 dollars. Then Alice gave 2 apples to Bob and kept the rest of the apples at home."


def pairs_of(spark, texts, items, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate.contaminated_pairs(docs, bench, **more).collect()}


def test_verbatim_passages_in_any_case_and_place(spark):
    short = "What is the longest river here"
    texts = [ITEM.upper(), ITEM.lower(), ITEM.title(), "question " + short, "Heading\n" + short, "QUESTION " + short.upper(), "of the longest river there is"]
    for sent in (decontaminate.MAX_SENT, 0):
        found = pairs_of(spark, texts, [ITEM, short], max_sent=sent)
        assert found == {(0, 0, True), (1, 0, True), (2, 0, True), (3, 1, True), (4, 1, True), (5, 1, True)}


LONG = "In 2019 the town of Alford counted 640 households and 12 schools . Later on the council asked every household about the price of water and the state of its roads , and 5 of its members wrote a report . The report was read aloud in the hall by 5 people who lived nearby , while all the others listened and took careful notes"


def test_one_other_value_drops_only_its_windows(spark):
    other = LONG.replace("640", "710").replace("12", "14").replace("5", "8").replace("2019", "2003")
    texts = [
        LONG.replace("by 5 people", "by 6 people"),  # one mention changed
        other.replace("by 8 people", "by 9 people"),  # other values, one of them against the rule
        ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("5", "4").replace("3", "4"),  # two numbers become one
        ITEM.replace("Alice", "Eve").replace("Bob", "Eve").replace("2", "7"),  # two names become one
    ]
    found = pairs_of(spark, texts, [LONG, ITEM])
    assert {(d, i) for d, i, _ in found} == {(0, 0), (1, 0), (2, 1)}


def test_judgement_of_an_alignment():
    window = lambda place, item, own, plain=False: {"place": place, "plain": plain, "item": item, "own": own}
    judge = decontaminate.judge
    assert judge([window(0, ["5"], ["5"]), window(1, ["5"], ["6"])]) == ([0], [0], False)  # itself, of equally many
    assert judge([window(0, ["5"], ["7"]), window(1, ["5"], ["6"])]) == ([], [], False)
    assert judge([window(0, ["5"], ["7"]), window(1, ["5"], ["7"]), window(2, ["5"], ["6"])]) == ([0, 1], [0, 1], False)
    assert judge([window(0, ["3"], ["4"]), window(1, ["5"], ["4"])]) == ([0, 1], [0, 1], False)
    assert judge([window(0, ["@ann"], ["@eve"]), window(1, ["@bob"], ["@eve"]), window(2, [], []), window(5, [], [], True)]) == ([2, 5], [2], False)
    assert judge([window(0, ["5"], ["6"]), window(1, ["5"], ["6"]), window(2, ["5"], ["5"])]) == ([0, 1, 2], [0, 1, 2], False)


def test_items_without_template_windows(spark):
    items = ["Compute 12 + 7 * 3 - 4.", "Define photosynthesis briefly.", "法国的首都是哪座城市?", "3 1 4 1 5 9 2 6 5 3 5 8 9 7", "What's 2?"]
    texts = ["Task: compute 12 + 7 * 3 - 4. Go on.", "Now define Photosynthesis briefly, please", "你知道法国的首都是哪座城市吗", "pi is 3 1 4 1 5 9 2 6 5 3 5 8 9 7 or so", "Compute 12 + 8 * 3 - 4. Define it briefly. 法国的城市 3 1 4"]
    for sent in (decontaminate.MAX_SENT, 0):
        assert pairs_of(spark, texts, items, max_sent=sent) == {(k, k, True) for k in range(4)}


def test_an_instruction_before_all_items_contaminates_nothing(spark):
    """Texts and items that share a front only: no pairs, for few and for very many of both, and no clean text is lost."""
    front = "answer the following multiple choice question by giving the letter of the one right choice only : "
    own = lambda kind, k: " ".join(f"{kind}{k}x{j}" for j in range(20))
    for n in (2, 5, 20, 50, 400):
        items = [front + own("item", k) for k in range(n)]
        clean = [front + own("doc", k) for k in range(n)]
        copies = [f"{own('before', k)} {items[k]}" for k in (0, n - 1)] + [own("item", 1)]
        assert {(d, i) for d, i, _ in pairs_of(spark, clean + copies, items)} == {(n, 0), (n + 1, n - 1), (n + 2, 1)}
    docs = spark.createDataFrame(list(enumerate(clean + copies)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert decontaminate.remove_contaminated(docs, bench).count() == 400


def test_items_of_one_template_and_items_without_windows_of_their_own(spark):
    """Versions of one template find another one; copies of an item, also in other spelling, are all reported."""
    versions = [ITEM.replace("5", str(10 + k)) for k in range(6)]
    found = pairs_of(spark, [ITEM.replace("5", "77")], versions)
    assert {(d, i) for d, i, _ in found} == {(0, k) for k in range(6)}
    same = [LONG] * 40 + [LONG + " " + "!" * k for k in range(1, 40)]
    assert {(d, i) for d, i, _ in pairs_of(spark, ["In front " + LONG, "clean"], same)} == {(0, k) for k in range(79)}


def brute_pairs(texts, items, least):
    """Items of one or two words by their bare lower-case words in a row."""
    bare = lambda t: [w.strip(".,!?;:'\"()").lower() for w in (t or "").split()]
    out = set()
    for i, item in enumerate(items):
        words = bare(item)
        for d, text in enumerate(texts):
            own = bare(text)
            if least <= len(words) <= 2 and any(own[k : k + len(words)] == words for k in range(len(own) - len(words) + 1)):
                out.add((d, i))
    return out


def test_short_items_by_a_parameter(spark):
    items = ["Osmosis?", "define osmosis", "too short", None, "", "three whole words"]
    texts = ["what is Osmosis, then", "Define: osmosis!", "it is too short", "short too", "nothing", None, "three whole words"]
    rows = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(d, i) for d, i, _ in pairs_of(spark, texts, items)} == {(6, 5)}
    for least in (1, 2):
        assert {(d, i) for d, i, _ in pairs_of(spark, texts, items, least=least)} == brute_pairs(texts, items, least) | {(6, 5)}
    assert sorted((r[0], r[1]) for r in decontaminate.short_items(rows).collect()) == [(0, 1), (1, 2), (2, 2)]


def template_tokens(text):
    """Tokens by the rules of the docstring, for texts whose words are letters, digits and . , ! ? : ; only."""
    out, start, after_number = [], True, False
    for word in text.split():
        low = word.strip("!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()
        if not low:
            start = word.rstrip("\"')]*#&$%|")[-1:] in tuple(".!?:;") or False
            continue
        number = low.replace(".", "").replace(",", "").isdigit() or low in decontaminate.NUMBER_WORDS
        bare = word.strip("!\"#&'()*+,-./:;<=>?@[\\]^_`{|}~")
        if number:
            kind = "<num>"
        elif after_number and low in decontaminate.UNITS:
            kind = "<unit>"
        elif bare[0].isupper() and (len(bare) == 1 or bare[1:].islower()) and not start:
            kind = "<name>"
        else:
            kind = low
        out.append((kind, low))
        start, after_number = word.rstrip("\"')]*#&$%|")[-1:] in tuple(".!?:;"), number
    return out


def test_against_a_brute_force_matcher_over_the_test_table(spark, sf_dir):
    """Every pair with half of an item's plain windows in a text, found by comparing all windows, is reported; the others
    have half of its template windows, or six windows in a row by either."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(docs, bench).collect()}
    cut = lambda tokens, k: [tuple(t[k] for t in tokens[i : i + 8]) for i in range(len(tokens) - 7)]
    items = {r["item_id"]: template_tokens(r["text"]) for r in bench.collect()}
    exact, loose = set(), set()
    for r in docs.where("text is not null").collect():
        tokens = template_tokens(r["text"])
        plain, template = set(cut(tokens, 1)), set(cut(tokens, 0))
        for i, item in items.items():
            own, own_template = cut(item, 1), cut(item, 0)
            hits = [w in plain for w in own]
            either = [a or w in template for a, w in zip(hits, own_template)]
            if 2 * sum(hits) >= len(own):
                exact.add((r["doc_id"], i))
            if 2 * sum(either) >= len(own) or any(all(either[k : k + 6]) for k in range(len(either) - 5)):
                loose.add((r["doc_id"], i))
    assert exact and exact <= got <= loose


def test_common_windows_count_where_a_pair_shares_another(spark, monkeypatch):
    """With a low limit for common windows the pairs and their coverage are those without a limit, and the common windows are counted."""
    front = "answer the following multiple choice question by giving the letter of the one right choice only : "
    own = lambda kind, k: " ".join(f"{kind}{k}x{j}" for j in range(20))
    items = [front + own("item", k) for k in range(6)] + [front + "7 8 9"]
    texts = [front + own("doc", 0), front + own("item", 1), own("item", 2), "before " + items[3], front]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = lambda common: sorted((r["doc_id"], r["item_id"], r["n_matched"], r["coverage"]) for r in decontaminate.contaminated_pairs(docs, bench, common=common).collect())
    found = rows(3)
    assert [r for r in found if r[1] < 6] == [r for r in rows(100) if r[1] < 6]
    assert {(d, i) for d, i, *_ in found} == {(1, 1), (2, 2), (3, 3)}
    assert {d: n for d, _, n, _ in found}[1] > {d: n for d, _, n, _ in found}[2] + 12


def test_many_versions_of_one_template_find_another_one(spark):
    """Forty versions of an item: windows by templates that all of them hold still are a measure; so is a passage in capitals of items that differ in capitals."""
    versions = [ITEM.replace("5", str(10 + k)) for k in range(40)]
    assert {(d, i) for d, i, _ in pairs_of(spark, [ITEM.replace("5", "77"), "clean"], versions)} == {(0, k) for k in range(40)}
    words = LONG.split()
    cased = [" ".join(w.title() if j in (20 + k, 21 + k) else w for j, w in enumerate(words)) for k in range(30)] + [" ".join(w.title() if j in (8, 20 + k) else w for j, w in enumerate(words)) for k in range(10)]
    assert {(d, i) for d, i, _ in pairs_of(spark, [LONG.upper()], cased)} == {(0, k) for k in range(40)}


def test_no_result_depends_on_the_limit_of_common_windows(spark):
    front = "answer the following multiple choice question by giving the letter of the one right choice only : "
    own = lambda kind, k, n=20: " ".join(f"{kind}{k}x{j}" for j in range(n))
    items = [front + own("item", k) for k in range(3)] + [front + f"{7 + k} 2 {29 + k}" for k in range(5)] + [front, front + own("group", 0), front + own("group", 0) + " " + own("tail", 0)]
    items += [ITEM.replace("5", str(10 + k)) for k in range(5)]
    texts = [front + own("doc", 0), front + "1 2 3", front + own("item", 1), own("group", 0), ITEM.replace("5", "77"), front[:50], own("group", 0, 14), "clean"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = lambda common: sorted((r["doc_id"], r["item_id"], r["n_matched"], r["n_aligned"], r["coverage"]) for r in decontaminate.contaminated_pairs(docs, bench, common=common).collect())
    found = rows(100)
    assert found == rows(1) == rows(3)
    by_text = {d: {i for x, i, *_ in found if x == d} for d in range(len(texts))}
    # the front alone is one item's whole text, and no sign of any other; seven windows of two items weigh 7 in the one that has none of its own
    assert by_text == {0: {8}, 1: {3, 4, 5, 6, 7, 8}, 2: {1, 8}, 3: {9, 10}, 4: {11, 12, 13, 14, 15}, 5: set(), 6: {9}, 7: set()}
