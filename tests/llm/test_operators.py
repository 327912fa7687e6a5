"""Every operator against brute force or an exact round trip, and on hard rows."""

import hashlib
import re
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillwise.llm import chat, decontamination, jaccard_join, language, mixing, pii, secrets, toxicity, warc
from tillwise.llm.exact_dedup import exact_dedup, without_duplicates
from tillwise.llm.jaccard_join import jaccard_groups, one_per_group
from tillwise.llm.sketch import among, bits

from .conftest import DOCUMENTS, HARD


def test_exact_dedup(documents):
    got = {r.doc_id: r for r in exact_dedup(documents((1, "a b"), (2, "a  b"), (3, "ab"), (4, "abc"), (5, None), (6, " ")),
                                            digests=True).collect()}
    assert [got[i].keep_id for i in (1, 2, 3, 4, 5, 6)] == [2, 2, 2, 4, 6, 6]
    assert [got[i].group_size for i in (1, 4, 5)] == [3, 1, 2]
    assert got[4].text_sha256 == hashlib.sha256(b"abc").hexdigest()


def test_exact_dedup_hard_rows(documents):
    docs = documents(*HARD)
    rows = exact_dedup(docs).collect()
    assert len(rows) == len(HARD)
    assert {r.keep_id for r in rows if r.doc_id in (3, 4)} == {3}
    stay = without_duplicates(docs)
    assert stay.columns == docs.columns
    # Null, empty and white space are one group (the longest stays), the repeated row stays once.
    assert sorted(str(r.doc_id) for r in stay.collect()) == ["3", "5", "6", "7", "None"]
    assert exact_dedup(documents().select("doc_id", "text")).count() == 0


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def _brute_groups(rows):
    sets = {i: _shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(documents):
    draw = random.Random(7)
    words = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(400)]
    common = " ".join(draw.choices(words, k=60))
    rows = []
    for group in range(12):
        base = draw.choices(words, k=draw.randint(3, 120))
        for _ in range(draw.randint(1, 25)):
            text = list(base)
            for _ in range(draw.randint(0, 5)):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append(" ".join(text) + (" " + common if group % 3 == 0 else ""))
    rows += [None, "", "one", "ONE", "a b c d", "A B c D"]
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(documents(*rows)).collect()}
    assert got == _brute_groups(rows)
    assert len({c for _, c in got.values()}) < len(rows)


def test_jaccard_join_links(documents, monkeypatch):
    """n_links by brute force, in many blocks, some of them empty."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 2)
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(300)]
    rows = [None, "", "one", "ONE", " one ", "a b"]
    for _ in range(5):
        base = draw.choices(words, k=60)
        for _ in range(8):
            text = list(base)
            text[draw.randrange(len(text))] = draw.choice(words)
            rows += [" ".join(text), "  ".join(text).upper()][:draw.randint(1, 2)]
    rows = list(enumerate(rows + [rows[-1]] * 3))
    sets = {i: _shingles(t) for i, t in rows}
    want = {a: sum(a != b and bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
                   for b in sets) for a in sets}
    assert {r.doc_id: r.n_links for r in jaccard_groups(documents(*rows)).collect()} == want


def test_jaccard_join_passages_alone_make_no_cluster(documents, monkeypatch):
    """Near copies in pairs, one of each pair with a passage of the next pair: what is compared
    set by set, and so dealt out to pairs of blocks, does not grow to all that share a passage."""
    held = {}
    kept = jaccard_join.written_once
    monkeypatch.setattr(jaccard_join, "written_once", lambda df, label="table": held.setdefault(label, kept(df, label))
                        if label == "clusters" else kept(df, label))
    draw = random.Random(9)
    text = lambda n: ["".join(draw.choices("abcdefghij", k=9)) for _ in range(n)]
    passages, rows = [text(14) for _ in range(12)], []
    for i in range(12):
        base = text(400)
        rows += [base[:200] + passages[i] + base[214:300] + passages[i - 1] + base[314:], base]
    got = {r.doc_id: r.component_id for r in jaccard_groups(documents(*[" ".join(row) for row in rows])).collect()}
    assert got == {i: i - i % 2 for i in range(24)}
    assert [r["count"] for r in held["clusters"].groupBy("component").count().collect()] == [2] * 12


def test_jaccard_join_many_copies(documents):
    """Groups of more sets than are paired one by one, near the threshold."""
    draw = random.Random(10)
    words = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(500)]
    rows = ["one", "two", None]
    for group in range(14):
        base = draw.choices(words, k=draw.choice([6, 30, 90, 200]))
        for _ in range(group):
            text = list(base)
            at = draw.randrange(len(text))
            text[at:at + len(text) // draw.choice([8, 12, 30])] = draw.choices(words, k=len(text) // 12)
            rows.append(" ".join(text))
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(documents(*rows)).collect()}
    assert got == _brute_groups(rows)


def test_parities_never_differ_more_than_sets():
    draw = np.random.default_rng(3)
    for size in (1, 5, 40, 300, 5000, 90_000):
        x = np.unique(draw.integers(0, 1 << 63, size, np.uint64))
        for share in (1.0, 0.9, 0.5, 0.0):
            y = np.unique(np.concatenate([x[:int(share * size)], draw.integers(0, 1 << 63, draw.integers(1, 2 * size + 1), np.uint64)]))
            apart = jaccard_join._differing(jaccard_join._parity(x), jaccard_join._parity(y))
            assert apart <= len(np.setxor1d(x, y))
            assert apart == jaccard_join._differing(jaccard_join._parity(y), jaccard_join._parity(x))


def test_bits_hold_their_keys(spark):
    held = bits(spark.createDataFrame([(None, 5), (0, 6), (7, -1), (-7, 1 << 62)], "doc_id long, fp long"))
    ids, hashes = pa.array([None, 0, 7, -7, None, 0, 7, 8]), np.array([5, 6, -1, 1 << 62, 6, 5, -2, -1])
    assert among(held, ids, hashes).tolist() == [True] * 4 + [False] * 4


def test_jaccard_join_hard_rows(documents):
    docs = documents(*HARD)
    got = jaccard_groups(docs)
    assert got.count() == len(HARD)
    assert {r.component_id for r in got.filter("doc_id in (3, 4)").collect()} == {3}
    stay = one_per_group(docs)
    assert stay.columns == docs.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == ["1", "2", "3", "3", "5", "6", "7", "None"]
    assert jaccard_groups(documents()).count() == 0


def test_mixing(documents):
    docs = documents(*[(i, "w " * (i % 9), "en", s) for i, s in enumerate(["a", "b", "c", "d", None] * 40)])
    rows = mixing.mixture(docs).collect()
    size = {r.source: r.source_size for r in rows}
    target = {r.source: r.target for r in rows}
    weights, total = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2])), 1.5 * sum(size.values())
    stopped = set()
    while True:  # the definition, round by round
        level = (total - sum(2 * size[s] for s in stopped)) / sum(w for s, w in weights.items() if s not in stopped)
        over = {s for s, w in weights.items() if s not in stopped and level * w > 2 * size[s]}
        if not over:
            break
        stopped |= over
    assert target == pytest.approx({s: 2 * size[s] if s in stopped else level * w for s, w in weights.items()})
    assert all(r.copies <= 2 and r.taken == r.copies * r["size"] for r in rows)
    mixed = mixing.mixed_rows(docs)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mixed.columns == [*docs.columns, "copy"]


def test_mixing_hard_rows(documents):
    assert mixing.mixture(documents(*HARD)).count() == len(HARD)
    assert mixing.mixture(documents()).count() == 0
    assert mixing.mixed_rows(documents((1, None), (2, ""))).count() == 0  # no words at all: rate 0


def test_toxicity(spark, documents):
    clean = [f"kind words about nice weather on day {i} and more for you" for i in range(40)]
    bad = [f"kind words about nice weather, you zorg and brask, on day {i}" for i in range(40)]
    docs = documents(*clean, *bad)
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(80)], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(docs, labels)
    texts = ["nice day", "you zorg brask", "you z0rg br@sk!", "zоrg brаsk", None, "", "a " * 50_000]
    got = {r.doc_id: r.score for r in toxicity.toxicity(documents(*texts), lexicon).collect()}
    assert got[0] < 0.3 <= got[1] and got[2] >= 0.3 and got[3] >= 0.3
    assert got[4] == got[5] == got[6] == 0
    assert toxicity.without_toxic(documents(*texts), lexicon).count() == 4
    assert toxicity.learn_lexicon(docs, labels.filter("toxic = 0")).weights == {}
    assert toxicity.toxicity(documents(*HARD), lexicon).count() == len(HARD)


def test_toxicity_exceptions_and_longest_term():
    lexicon = toxicity.Lexicon({" clown ": 2.0, " clow": 1.0, " foo": 1.0}, [" clown fish "])
    sums = toxicity._Matcher(lexicon).sums(["clown", "a clown fish", "clown. Fish!", "clowns foo", "CLOWN fish clown"])[0]
    assert list(sums) == [2.0, 0.0, 0.0, 2.0, 2.0]


def test_toxicity_exceptions_end_with_their_text():
    lexicon = toxicity.Lexicon({" clown ": 2.0}, [" clown fish ", " the clown "])
    matcher = toxicity._Matcher(lexicon)
    texts = ["a clown", "fish", "the", "clown", None, "clown fish", "you clown  ", " fish the", "", "clown"]
    alone = [float(matcher.sums([t])[0][0]) for t in texts]
    assert list(matcher.sums(texts)[0]) == alone == [2.0, 0.0, 0.0, 2.0, 0.0, 0.0, 2.0, 0.0, 0.0, 2.0]


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a\nb", "x" * 5000), (2, None, "x" * 5000), (3, "u", None), (4, "u", ""), (None, "u", "x" * 5000),
             (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (6, "v", "".join(map(chr, range(1, 2000))))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_warc(warc.with_record_types(frame).coalesce(1), str(tmp_path / "w"))
    want = [(1, "revisit", 2, 5000), (2, "response", None, 5000), (3, "revisit", 4, 0), (4, "response", None, 0)]
    for size in (13, 1000, 1 << 20):
        rows = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path / "w"), size).collect()}
        assert len(rows) == len(pages) and all(r.digest_agrees for r in rows.values())
        assert [(i, rows[i].record_type, rows[i].refers_to, rows[i].payload_bytes) for i in (1, 2, 3, 4)] == want
    found = {r.page_id: bytes(r.payload).decode() for r in warc.warc_records(spark, str(tmp_path / "w")).collect() if r.payload is not None}
    assert found[6] == pages[6][2] and found[5] == pages[5][2]


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "[\\INST]", "[ROLE x] y [/ROLE]", None, "", "a\nb", "\\\\<s>"]
    roles = ["user", "assistant", "system", "we]ird\\", None]
    rows = [(c, t, roles[(c + t) % 5], texts[(c * 3 + t) % 9]) for c in range(9) for t in range(9)]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (1, 1, "user", "tie")]
    formatted = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat.parsed(formatted).collect():
        assert (r.found_role or "") == (r.role or "") and (r.loss_text is None) == (r.role != "assistant")
        body = r.piece
        for control in ("<s>", "</s>", "[INST]", "[/INST]"):
            assert body.count(control) <= 1
    got = {r.conv_id: r for r in chat.conversation_digests(chat.examples(formatted)).collect()}
    assert len(got) == 10
    for c in range(9):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].n_examples) == (len(mine), sum(r[2] == "assistant" for r in mine))
    assert (got[None].n_turns, got[None].n_examples) == (2, 1)


@pytest.mark.parametrize("share", [1, 300, 1 << 24])
def test_chat_examples(spark, monkeypatch, share):
    """Every reply has its whole context, however the work is dealt out."""
    monkeypatch.setattr(chat, "SHARE_CHARS", share)
    monkeypatch.setattr(chat, "_BATCH_CHARS", 200)
    turns = [(1, t, ("user", "assistant")[t % 2], f"é{t} " * (t % 7)) for t in range(41)]
    turns += [(2, 0, "assistant", None), (2, 0, "assistant", None), (3, 0, "user", "open"), (4, None, "assistant", "x" * 300_000)]
    formatted = chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    pieces = {c: [r.piece for r in formatted.filter(f"conv_id = {c}").orderBy("position").collect()] for c in (1, 2, 3, 4)}
    got = sorted(chat.examples(formatted).collect(), key=lambda r: (r.conv_id, r.position))
    assert [(r.conv_id, r.position) for r in got] == [*((1, p) for p in [*range(2, 42, 2), 41]), (2, 1), (2, 2), (3, 1), (4, 1)]
    for r in got:
        assert r.text == "".join(pieces[r.conv_id][:r.position]) and r.is_last == (r.position == len(pieces[r.conv_id]))
        _, _, role, text = sorted(t for t in turns if t[0] == r.conv_id)[r.position - 1]
        if role == "assistant":
            assert r.text[r.loss_start:r.loss_end] == (text or "")
        else:
            assert r.is_last and r.loss_start is None and r.loss_end is None
    totals = {r.conv_id: r for r in chat.conversation_digests(chat.examples(formatted)).collect()}
    assert totals[1].example_chars == sum(len(r.text) for r in got if r.conv_id == 1 and r.loss_start is not None)
    assert (totals[3].n_examples, totals[3].example_chars, totals[3].loss_chars) == (0, 0, 0)


def test_chat_empty_table_and_clashing_names(spark):
    schema = "conv_id long, turn long, role string, text string, piece string, `first` long, share long, Position long, is_last long"
    none = chat.examples(chat.format_chat(spark.createDataFrame([], schema)))
    assert none.count() == 0 and chat.conversation_digests(none).count() == 0
    one = chat.examples(chat.format_chat(spark.createDataFrame([(1, 0, "assistant", "a", "p", 1, 2, 3, 4)], schema)))
    assert [r.text for r in one.collect()] == [" a </s>"]


def test_decontamination(spark, documents):
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(2, 6)))
    items = [" ".join(word() for _ in range(draw.randint(9, 40))) + ".\nAnswer " + word() for _ in range(30)]
    fill = lambda n: " ".join(word() for _ in range(n))
    texts = [fill(draw.randint(0, 300)) for _ in range(60)]
    planted = {}
    for i in range(0, 60, 4):
        planted[i] = draw.randrange(30)
        text = items[planted[i]]
        texts[i] = f"{texts[i]} {text.upper() if i % 8 else text.replace(' ', ', ')} {fill(50)}"
    benchmark = spark.createDataFrame([*enumerate(items), (98, None), (99, "too short"), (None, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contamination(documents(*texts), benchmark).collect()}
    assert got == set(planted.items())
    docs = documents(*texts)
    kept = decontamination.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60)) - set(planted)
    assert decontamination.contamination(documents(*HARD), benchmark).count() == 0
    assert decontamination.contamination(docs, benchmark.limit(0)).count() == 0


def test_short_items_are_found_as_one_run(spark, documents):
    items = [(1, "What is the capital of Peru? Lima."), (2, "Name the largest ocean.\nPacific"), (3, "Zyzzyva"), (4, " ?! "), (5, None),
             (6, "the capital of Peru is a long question that has many more words in it than the others.\nIndeed it has")]
    texts = ["They ask: what is the CAPITAL of Peru?\nLima! And so on " + "word " * 500,
             "The capital is Lima, of Peru, is what? the", "Name the largest ocean: Pacific", "name largest the ocean pacific",
             "a zyzzyva is a beetle", "zyzzyvas", "", None, "filler " * 3000 + "name the largest ocean pacific"]
    got = {(r.doc_id, r.item_id): r for r in decontamination.contamination(
        documents(*texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(0, 1), (2, 2), (4, 3), (8, 2)}
    assert all(r.score == pytest.approx(1) and r.question_overlap == r.answer_overlap == 1 for r in got.values())
    kept = decontamination.without_contaminated(documents(*texts), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7]


def _brute_contamination(items, texts, threshold=0.6, question=0.6, answer=0.5, run_words=8, k1=1.2, b=0.75):
    """Every passage against every item, with plain counters."""
    words = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    parts = [[words(p) for p in item.split("\n")] for item in items]
    whole = [q + a for q, a in parts]
    mean, n = sum(map(len, whole)) / len(whole), len(whole)
    df = Counter(w for x in whole for w in set(x))
    weights = []
    for x in whole:
        part = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(x) / mean))
                for w, tf in Counter(x).items()}
        weights.append({w: v / sum(part.values()) for w, v in part.items()})
    evidence = lambda x: {tuple(x[i:i + 3]) for i in range(len(x) - 2)} if len(x) >= 3 else {(w,) for w in x}
    longest = max(map(len, whole))
    step, found = max(8, longest // 2), {}
    for d, text in enumerate(texts):
        every = words(text)
        for first in range(0, max(len(every) - step, 1), step):
            passage = every[first:first + longest + step]
            grams = evidence(passage) | {(w,) for w in passage}
            for i, (q, a) in enumerate(parts):
                score = sum(v for w, v in weights[i].items() if w in passage)
                shares = [len(evidence(x) & grams) / len(evidence(x)) if x else 1.0 for x in (q, a)]
                if len(whole[i]) < run_words:
                    good = any(passage[k:k + len(whole[i])] == whole[i] for k in range(len(passage)))
                else:
                    good = score >= threshold - 1e-9 and shares[0] >= question and shares[1] >= answer
                if good and (score, sum(shares)) > found.get((d, i), (0, 0))[:2]:
                    found[d, i] = (score, sum(shares), first)
    return found


def test_contamination_equals_brute_force(spark, documents):
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    some = lambda n: draw.choices(vocabulary, k=n)
    items = [" ".join(some(draw.choice([1, 2, 4, 6, 9, 14, 30]))) + "\n" + " ".join(some(draw.choice([1, 2, 5]))) for _ in range(60)]
    texts = []
    for _ in range(160):
        text = some(draw.randint(0, 120))
        for item in draw.sample(items, 2):
            copy = [w if draw.random() > 0.1 else draw.choice(vocabulary) for w in item.split()]
            text[draw.randint(0, len(text)):0] = copy
        texts.append(" ".join(text))
    want = _brute_contamination(items, texts)
    rows = decontamination.contamination(documents(*texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
                                         .select("item_id", F.substring_index("text", "\n", 1).alias("question"),
                                                 F.substring_index("text", "\n", -1).alias("answer"))).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == set(want) and len(want) > 100
    for r in rows:
        score, shares, _ = want[r.doc_id, r.item_id]
        assert r.score == pytest.approx(score) and r.question_overlap + r.answer_overlap == pytest.approx(shares)


def test_block_bounds_lose_nothing():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(draw.choices(words, k=draw.randint(10, 40))) for _ in range(70)]
    idf = {int(w): 1 + draw.random() for w in np.unique(np.concatenate(decontamination._words(texts))).view(np.int64)}
    index = decontamination.build_index([(i, t, "", idf) for i, t in enumerate(texts)], 1.2, 0.75, 25.0)
    for _ in range(200):
        terms = np.array(sorted(draw.sample(range(len(index.terms)), draw.randint(1, 40))))
        want = np.zeros(len(texts))
        for t in terms:
            part = slice(index.at[t], index.at[t + 1])
            want[index.item[part]] += index.score[part]
        items, scores = decontamination.retrieve(index, terms, 0.3)
        assert list(items) == list(np.flatnonzero(want >= 0.3)) and scores == pytest.approx(want[items])


def test_secrets(documents):
    text = ('password = "abc" token=token:abcdefg api_key: "Zx9+/=qwe" é AKIA' + "A1" * 10 + " AKIAX "
            + "0123456789abcdef" * 2 + " secret='longenough'")
    row = secrets.secrets(documents(text)).first()
    want = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6]
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert sorted(tuple(s) for s in row.base) == sorted(want)
    assert (row.n_assign, row.n_access, row.n_hex) == (2, 1, 1)


def test_secrets_random_tokens(documents):
    draw = random.Random(11)
    token = lambda: "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=40))
    texts = [f"see {token()} here" for _ in range(60)] + ["the wordlikewordlikewordlikewordlikeword is not" for _ in range(60)]
    rows = {r.doc_id: r for r in secrets.secrets(documents(*texts)).collect()}
    assert sum(rows[i].n_random for i in range(60)) >= 50
    assert sum(rows[i].n_random for i in range(60, 120)) == 0
    hard = secrets.secrets(documents(*HARD))
    assert hard.count() == len(HARD)
    assert secrets.secrets(documents()).count() == 0


def test_secrets_few_random_tokens(documents):
    """One to five random tokens in a class of their own, with words beside them."""
    draw = random.Random(3)
    signs = {"base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
    rows, classes = ["the wordlikewordlikewordlikewordlikeword is not"] * 20, []
    for alphabet in signs.values():
        for n, length in enumerate((23, 32, 46, 64, 91), 1):  # one length class each
            classes.append(range(len(rows), len(rows) + n))
            rows += ["see " + "".join(draw.choices(alphabet, k=length)) + " here" for _ in range(n)]
    got = {r.doc_id: r.n_random for r in secrets.secrets(documents(*rows)).collect()}
    assert sum(got[i] for i in range(20)) == 0
    assert sum(got[i] for c in classes for i in c) >= 26  # of 30
    assert sum(any(got[i] for i in c) for c in classes) >= 9


def test_secrets_in_paths_and_mixed_runs(documents):
    draw = random.Random(4)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    token = lambda more: "".join(draw.choices(signs, k=25)) + more + "".join(draw.choices(signs, k=25))
    path = "https://host.example/user-files/upload-folder/{}/last_page/the-old-index-of-everything"
    kinds = [[path.format(token("x")) for _ in range(30)], [token("+/-_") for _ in range(30)],
             ["1//0g" + token("-_") for _ in range(30)], ["the-session_name_of-it_" + token("+/") for _ in range(30)]]
    rows = {i: r for i, r in enumerate(r for k in kinds for r in k)}
    got = {r.doc_id: r for r in secrets.secrets(documents(*rows.items(), (999, path.format("here")))).collect()}
    for k in range(4):
        assert sum(got[i].n_random == 1 for i in range(30 * k, 30 * k + 30)) >= 24
    assert got[999].n_random == 0
    spans = [rows[i][s.start:s.end] for i in range(30) for s in got[i].all_spans]
    assert all(s in path.format(s) and len(s) == 51 for s in spans)  # the key, without its path


def test_spans_of_many_matches(documents):
    text = " ".join(f"token=abcdef{i}" for i in range(300))
    row = secrets.secrets(documents(text)).first()
    assert [tuple(s) for s in row.base] == [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text)]


def test_language(spark, documents):
    sounds = {"en": "the and ing th er", "de": "der und sch ung en", "fr": "le et eau que ou", "es": "el y cion que os"}
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choices(sounds[lang].split(), k=30)), lang, "a") for i, lang in enumerate(list(sounds) * 40)]
    learned = language.learn_languages(documents(*rows, (900, None, "en", "a"), (901, "text", None, "a")))
    fresh = [(i, " ".join(draw.choices(sounds[lang].split(), k=30)), lang, "a") for i, lang in enumerate(list(sounds) * 10)]
    got = {r.doc_id: r.lang_pred for r in language.identify(documents(*fresh, (99, "12 34"), (98, None), (97, "")), learned).collect()}
    assert sum(got[i] == lang for i, _, lang, _ in fresh) >= 38
    assert got[99] == got[98] == got[97] == "und"
    assert language.identify(documents(*HARD), learned).count() == len(HARD)
    assert language.identify(documents("a text"), language.learn_languages(documents())).first().lang_pred == "und"


def test_pii_field_learns_its_lines():
    field = pii.train(pii.labelled_lines())
    for words, labels in pii.labelled_lines():
        for a, b in pii._runs(words):
            found = field.decode(field.scores([[pii.features(words, i) for i in range(a, b)]]))[0]
            assert [pii.LABELS[k] for k in found] == labels[a:b]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    field = pii.Field({}, np.zeros((0, 6)), rng.normal(size=(6, 6)))
    runs = [rng.normal(size=(n, 6)) for n in (1, 2, 4, 4, 3)]
    import itertools
    for e, path in zip(runs, field.decode(runs)):
        value = lambda p, e=e: sum(e[i, k] for i, k in enumerate(p)) + sum(
            field.step[a, b] for a, b in zip((0, *p), (*p, 0)))
        assert value(tuple(path)) == pytest.approx(max(value(p) for p in itertools.product(range(6), repeat=len(e))))


def test_pii_spans(documents):
    field = pii.train(pii.labelled_lines())
    text = ("é mail a.b@c.d.e@f.g or x@y, 1.2.3.256 1.2.3.4.5 +1 (017) 555-7713, 4111 1111 1111 1111, "
            "4111111111111112, call 555-123-4567 now")
    row = pii.personal_data(documents(text), field).first()
    forms = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"]
    emails, ips = ([(m.start(), m.end()) for m in re.finditer(f, text)] for f in forms)
    base = [(s.kind, s.start, s.end) for s in row.base]
    assert [s[1:] for s in base if s[0] == "email"] == emails
    assert [s[1:] for s in base if s[0] == "ip"] == [s for s in ips if "256" not in text[slice(*s)]]
    assert [text[a:b] for k, a, b in base if k == "card"] == ["4111 1111 1111 1111"]
    assert "555-123-4567" in [text[s.start:s.end] for s in row.spans if s.kind == "phone"]
    assert set(base) <= {(s.kind, s.start, s.end) for s in row.spans}
    assert pii.personal_data(documents(*HARD), field).count() == len(HARD)


def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F
    clash = ["score", "position", "n", "fp", "size", "maybe", "target", "source_size", "copies", "component_id", "_t", "length"]
    rows = [(1, "a b c d e f", "en", "s", 3), (2, "a b c d e f", "en", "s", 3)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumns({c: F.lit(1) for c in clash})
    assert exact_dedup(docs).count() == jaccard_groups(docs).count() == mixing.mixture(docs).count() == 2
    for stage in (without_duplicates, one_per_group, mixing.mixed_rows):
        assert set(docs.columns) <= set(stage(docs).columns) and stage(docs).count() >= 1


def test_stages_keep_columns_of_any_name(spark):
    """Names of the operators' own columns, in other cases and with underscores, come out as they went in."""
    from pyspark.sql import functions as F
    own = ["sha", "gone_id", "Gone_Sha", "position", "_POSITION", "of", "Target", "source_size", "_copies", "copies", "gone",
           "_sha", "text_sha256", "kept", "component_id", "a.b"]
    same = "one two three four five six seven"
    docs = spark.createDataFrame([(1, same, "en", "s", 3), (2, same, "en", "s", 3), (3, "eight nine", "en", None, 3)], DOCUMENTS)
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(own)})
    for stage, stay in ((without_duplicates, {1, 3}), (one_per_group, {1, 3}), (mixing.mixed_rows, {1, 2, 3})):
        got = stage(docs)
        rows = got.collect()
        assert got.columns[:len(docs.columns)] == docs.columns and {r.doc_id for r in rows} <= stay and rows
        assert all(r[5:5 + len(own)] == tuple(range(len(own))) for r in rows)
    copies = mixing.mixed_rows(docs.withColumn("Copy", F.lit(77)))
    assert copies.columns == [*docs.columns, "copy"] and max(r["copy"] for r in copies.collect()) < 2


def test_slices_are_bounded_and_whole():
    import pyarrow as pa
    from tillwise.llm.textscan import slices
    texts = ["ab" * 5, None, "", "x" * 100, "y", "ä" * 6, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "text"]).slice(1)
    got = [s.column(0).to_pylist() for s in slices(batch, 1, 3, 13)]
    assert got == [[1, 2], [3], [4, 5, 6]]
    assert list(slices(batch.slice(0, 0), 1, 3, 13)) == []
