"""Cleaning, codec, transliteration and respelling on invented strings."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lekha.functions import charvocab, codec, metrics, nfc, pointwise, spelling, text, translit, wordwise
from lekha.functions.expr import strip, word_count
from lekha.operators import reports
from lekha.plans import catalog


def one(spark, value, column):
    schema = "t string" if isinstance(value, (str, type(None))) else "t array<string>"
    return spark.createDataFrame([(value,)], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [
    ("a||b|c", "॥ ।"), ("ಕ​ಖ﻿", "ಕಖ"), ("ಕ, ಖ! (ಗ) ಘ", "ಕ ಖ ಗ ಘ"), ("  abc 12 ", ""), ("ಕ　\x1fಖ", "ಕ ಖ"),
])
def test_clean_manuscript(spark, raw, want):
    assert one(spark, raw, text.clean_manuscript("t")) == want


def test_strip_and_words_follow_unicode_whitespace(spark):
    assert one(spark, " \x1c a b c \x85", strip("t")) == "a b c"
    assert one(spark, "  a b c ", word_count("t")) == 3


def test_single_line_keeps_inner_spacing(spark):
    assert one(spark, "\n a\tb\nc ", text.single_line("t")) == "a b c"


def test_shortest_reading_prefers_the_earlier_key(spark):
    df = spark.sql("SELECT map('i1', 'a b c', 'i2', 'x y', 'i3', 'p q') AS m")
    assert df.select(text.shortest_reading("m")).first()[0] == "x y"


@pytest.mark.parametrize("raw, want", [
    ("<think>ಕ\n</think> ಖಗ abc।", "ಖಗ ।"), (" UNREADABLE\n", ""), ("UNREADABLE ಕ", "ಕ"), ("ಕ‍ಖ", "ಕ‍ಖ"),
])
def test_clean_reply(spark, raw, want):
    assert one(spark, raw, text.clean_reply("t")) == want


@pytest.mark.parametrize("raw, n, want", [
    ("1: a\n2) b\nnote", 2, ["a", "b"]), ("2. b\r\n 1 : a", 2, ["a", "b"]), ("1: a\n1: b", 2, None), ("1: a", 2, None),
    ("೧: a", 1, ["a"]), ("", 0, None), ("99999999999999999999: a", 1, None), ("<think>1: z</think>1: a", 1, ["a"]),
])
def test_numbered_reply(spark, raw, n, want):
    assert one(spark, raw, text.parse_numbered_reply("t", n)) == want


def test_sentences_split_and_keep_order(spark):
    assert one(spark, "ಕ ಖ। ಗ॥ಘ|ಙ||ಚ. \n!", text.sentences("t")) == ["ಕ ಖ", "ಗ", "ಘ", "ಙ", "ಚ"]


def test_band_and_caps(spark):
    df = spark.createDataFrame([("abcd", "abc"), ("", "a"), ("ab", "abc"), ("a", "ab")], "o string, m string")
    assert [r[0] for r in df.select(text.in_band("o", "m")).collect()] == [True, False, True, False]
    assert one(spark, "a" * 701, text.usable_length("t")) is False


@pytest.mark.parametrize("path, stem, page", [
    ("d/std/4.64(1).jpg", "4.64", "4.64"), ("d/hd_images/2.7.png", "2.7", "2.7_hd"), ("x/.jpg", ".jpg", ".jpg"),
])
def test_page_names(spark, path, stem, page):
    assert one(spark, path, text.page_stem("t")) == stem
    assert one(spark, path, text.page_id("t")) == page


def test_scaled_width_rounds_half_to_even(spark):
    df = spark.createDataFrame([(5, 128), (7, 128), (1, 900)], "w int, h int")  # 2.5, 3.5, tiny
    assert [r[0] for r in df.select(text.scaled_width("w", "h", step=1)).collect()] == [2, 4, 1]


def test_quality_bucket_order(spark):
    df = spark.createDataFrame([(50.0, 30.0, 100.0), (30.0, 30.0, 100.0), (50.0, 11.9, 100.0), (50.0, 30.0, 241.0),
                                (None, None, None)], "s double, c double, b double")
    assert [r[0] for r in df.select(text.quality_bucket("s", "c", "b")).collect()] == [
        "good", "acceptable", "broken", "broken", "broken"]


def test_nfc(spark):
    assert one(spark, " é  x ", nfc.normalise("t")) == "é x"


# ---- codec ------------------------------------------------------------------


def test_vocabulary_is_sorted_numbered_and_extended_at_the_end(spark):
    vocab = codec.KANNADA.vocab
    assert vocab == sorted(vocab) and len(vocab) == 56
    assert codec.KANNADA.extended_vocab[:56] == vocab and len(codec.KANNADA.extended_vocab) == 66
    rows = codec.vocab_table(spark, digits=True).orderBy("index").collect()
    assert rows[0]["symbol"] == "<blank>" and rows[66]["symbol"] == "#9"


def test_every_letter_round_trips(spark):
    script = codec.KANNADA
    texts = [c for c in [*script.consonants, *script.vowels, *script.signs, *script.punctuation]]
    texts += [c + m for c in script.consonants for m in [*script.matras, script.virama]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    back = df.select("t", codec.decode(codec.encode("t")).alias("b"), codec.round_trips("t").alias("r")).collect()
    assert all(r["t"] == r["b"] and r["r"] for r in back)


@pytest.mark.parametrize("word, symbols", [
    ("ಮರ", "m|a|r|a"), ("ಕ್ಕೋ", "k|k|O"), ("ಆನೆ", "A|n|e"), ("ಹೞೆ ಱ।", "h|a|zY|e|sp|rY|a|danda"), ("ಸಂಃ", "s|a|M|H"), ("", ""),
])
def test_encode_words(spark, word, symbols):
    assert one(spark, word, codec.to_string(codec.encode("t"))) == symbols
    assert one(spark, word, codec.decode(codec.from_string(codec.to_string(codec.encode("t"))))) == word


@pytest.mark.parametrize("bad", ["abc", "ಾಕ", "್", "ಕಾಾ", "ಕ್ಾ", "ಕ\n", "೧", "ಌ", "ಕೄ"])
def test_text_outside_the_alphabet_is_null(spark, bad):
    assert one(spark, bad, codec.encode("t")) is None
    assert one(spark, bad, codec.round_trips("t")) is False


def test_digits_are_opt_in_for_encoding_only(spark):
    assert one(spark, "೧೦", codec.encode("t", digits=True)) == ["#1", "#0"]
    assert one(spark, ["#1", "k", "a"], codec.decode("t")) == "೧ಕ"


def test_decode_unknown_and_ambiguous(spark):
    assert one(spark, ["k", "??"], codec.decode("t")) is None
    assert one(spark, "ಕ್ಅ", codec.round_trips("t")) is False  # reads back as ಕ
    assert one(spark, "ಕ್ಅ", codec.decode(codec.encode("t"))) == "ಕ"
    assert one(spark, ["a", "k", "k", "i", "u"], codec.decode("t")) == "ಅಕ್ಕಿಉ"


def test_indices_and_packing(spark):
    ids = one(spark, "ಕ ", codec.indices(codec.encode_packed("t")))
    names = codec.KANNADA.vocab
    assert [names[i - 1] for i in ids] == ["k", "a", "sp"]
    assert one(spark, "ಕ ", codec.pack_indices(codec.indices(codec.encode_packed("t")), 70) == codec.encode_packed("t"))


# ---- transliteration and respelling ----------------------------------------------


@pytest.mark.parametrize("typed, want", [
    ("mane", "ಮನೆ"), ("pustaka", "ಪುಸ್ತಕ"), ("aarai", "ಆರೈ"), ("aii", "ಐಇ"), ("aaa", "ಆಅ"), ("chhatri", "ಛತ್ರಿ"),
    ("kq a", "ಕ್ ಅ"), ("q", "q"), ("kuu||", "ಕೂ॥"), ("3 |", "೩ ।"), ("ಕa", "ಕಅ"), ("saMhaH", "ಸಂಹಃ"), ("~na~Na", "ಞಙ"),
    ("karYlYA", "ಕಱ್ೞಾ"), ("x z", "x z"), ("Shasha", "ಷಶ"), ("Rk", "ಋಕ್"), ("", ""),
])
def test_transliterate(spark, typed, want):
    assert one(spark, typed, translit.to_kannada("t")) == want


def test_nasals_before_each_class(spark):
    assert one(spark, "ಅಂಕ ಅಂಜ ಅಂಟ ಅಂತ ಅಂಪ ಅಂಸ ಅಂ", spelling.homorganic_nasals("t")) == "ಅಙ್ಕ ಅಞ್ಜ ಅಣ್ಟ ಅನ್ತ ಅಮ್ಪ ಅಂಸ ಅಂ"


def test_archaic_swap_sites_rate_and_stability(spark):
    site = "ಕಿರಕ"  # a vowel sign before, a plain consonant after: not a site
    assert one(spark, site, spelling.archaic_swap("t", "ರ", "ಱ", F.lit(1), rate=1.0)) == site
    assert one(spark, "ಆರಆ", spelling.archaic_swap("t", "ರ", "ಱ", F.lit(1), rate=1.0)) == "ಆಱಆ"
    df = spark.range(4000).select("id", F.lit("ಆರಆರಆ").alias("t"))
    swapped = df.select("id", spelling.archaic_swap("t", "ರ", "ಱ", "id").alias("s"))
    first = {r["id"]: r["s"] for r in swapped.collect()}
    again = {r["id"]: r["s"] for r in swapped.repartition(7).collect()}
    rate = sum(s.count("ಱ") for s in first.values()) / 8000
    assert first == again and 0.13 < rate < 0.17


def test_character_vocabulary(spark):
    df = spark.createDataFrame([(1, "ba"), (2, "cz"), (3, "")], "k int, t string")
    vocab = charvocab.build_char_vocab(df.where("k < 2"), "t")
    assert {(r["char"], r["id"]) for r in vocab.collect()} >= {("<pad>", 0), ("<unk>", 3), ("a", 4), ("b", 5)}
    ids = {r["k"]: r["ids"] for r in charvocab.encode_chars(df, ["k"], "t", vocab).collect()}
    assert ids == {1: [5, 4], 2: [3, 3], 3: []}
    names = F.array(*[F.lit(c) for c in ["<pad>", "<bos>", "<eos>", "<unk>", "a", "b"]])
    got = spark.sql("SELECT array(1, 5, 0, 4, 3, 2, 5) AS ids").select(charvocab.decode_ids("ids", names)).first()[0]
    assert got == "ba<unk>"
    assert one(spark, "aéa", text.missing_chars("t", F.array(F.lit("a")))) == ["é"]


def test_words_are_rewritten_once_and_nulls_stay():
    texts, seen = pa.array(["b a  a", None, "", " a\nb", "a b"] * 50), []

    def rule(words):
        seen.append(words)
        return words.upper()

    assert wordwise.rewrite(texts, rule).to_pylist() == ["B A  A", None, "", " A\nB", "A B"] * 50
    assert len(seen) == 1 and sorted(seen[0].split(" ")) == ["", "a", "a\nb", "b"]
    assert wordwise.rewrite(texts, rule, bad="^a$").to_pylist()[:5] == [None, None, "", " A\nB", None]
    assert wordwise.rewrite(texts.slice(3, 1), rule, full=True).to_pylist() == ["A B"]
    assert wordwise.rewrite(texts.slice(0, 0), rule).to_pylist() == []


def test_word_rules_equal_the_scan_of_whole_texts(spark):
    """Random texts against the rules as regexes over whole texts."""
    rng = random.Random(3)
    typed = ["".join(rng.choice("kkhgCTrYlaAaiiueoRqMH19| \n|.~N-ಕಾಿ್é") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    cons = "[" + "".join(translit._CONS) + "]"
    vowels = "[" + "".join(translit._VOWEL_CODE.values()) + "]"
    signs = "".join(filter(None, translit.MATRA_OF.values()))

    def by_scan(t):
        for k in translit._LONG_CONSONANTS:
            t = t.replace(k, translit._CONSONANT_CODE[translit.CONSONANTS[k]])
        t = re.sub("|".join(translit._LONG_VOWELS), lambda m: translit._VOWEL_CODE[translit.VOWELS[m[0]]], t)
        t = re.sub(f"(?<={cons})(?={vowels})", "\x04", t)
        for v, code in translit._VOWEL_CODE.items():
            if v != "ಅ":
                t = t.replace("\x04" + code, translit.MATRA_OF[v])
        t = re.sub(f"(?<={cons})(?![\x04q{signs}])", "್", t)
        t = re.sub(f"(?<={cons})q", "್", t)
        return t.replace("\x04a", "").replace("||", "॥").translate(str.maketrans(translit._FINAL))

    rows = spark.createDataFrame(list(enumerate(typed)), "i int, t string").repartition(3)
    got = rows.select("i", translit.to_kannada("t").alias("k")).select("i", "k", text.clean_manuscript("k").alias("c"))
    got = got.select("*", codec.decode_packed(codec.encode_packed("c", digits=True)).alias("d"), codec.encodable("c", True).alias("e"))
    for r in got.collect():
        assert r["k"] == by_scan(typed[r["i"]])
        gone = r["k"].replace("||", "॥").replace("|", "।")
        assert r["c"] == " ".join(re.sub("[a-zA-Z0-9.-]", " ", gone).split())
        assert (r["d"] is not None) == r["e"]
        assert r["d"] is None or r["d"] == re.sub("್([ಅ-ಔ])", lambda m: translit.MATRA_OF[m[1]], r["c"])


def test_bit_distance_equals_the_table(spark):
    rng = random.Random(5)

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    word = lambda: "".join(rng.choice("abé𝒳") for _ in range(rng.randint(0, 90)))
    pairs = [(word(), word()) for _ in range(400)] + [("", ""), ("", "ab"), ("a" * 3000, "a" * 2999 + "b")]
    for a, b in pairs[:-1]:
        assert metrics.distance(a, b) == table(a, b)
    rows = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    for r in rows.select("a", "b", metrics.agreement_cer("a", "b").alias("d"), metrics.agreement_within("a", "b", 0.35).alias("w")).collect():
        if r["a"] is None or r["b"] is None:
            assert r["d"] is None
            continue
        n = max(len(r["a"]), len(r["b"]))
        d = metrics.distance(r["a"], r["b"])
        assert r["d"] == (d / n if n else 0) and r["w"] == (r["d"] if d <= int(n * 0.35) else 1)


def test_sites_are_counted_once_per_distinct_word(spark):
    """Random texts against the rules as regexes over whole texts; a repeated word is scanned once."""
    rng = random.Random(5)
    rules = spelling.rule_sites()
    texts = ["".join(rng.choice("ರಳಂಕಚಟತಪಾಿಅ \n🙂") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").repartition(3)
    got = {r["i"]: r["n"] for r in rows.select("i", spelling.count_sites("t").alias("n")).collect()}
    assert got.pop(-1) is None
    assert got == {i: [len(re.findall(site, t)) for site in rules.values()] for i, t in enumerate(texts)}
    report = {r["rule"]: (r["firings"], r["lines"]) for r in reports.rule_firings(rows, "t").collect()}
    assert report == {rule: (sum(n[k] for n in got.values()), sum(n[k] > 0 for n in got.values())) for k, rule in enumerate(rules)}

    class Rule:
        seen = []

        def finditer(self, text):
            self.seen.append(text)
            return re.finditer("a", text)

    assert wordwise.count(pa.array(["ab a", None, "", "a ab ab"] * 40), [Rule()]).to_pylist()[:4] == [[2], None, [0], [3]]
    assert len(Rule.seen) == 1 and sorted(Rule.seen[0].split(" ")) == ["", "a", "ab"]
    assert wordwise.count(pa.array([], pa.string()), [Rule()]).to_pylist() == []


def test_rules_on_code_points_see_one_text_at_a_time(monkeypatch):
    """Random texts in small pieces and in one: each as if it stood alone; null, empty and void texts keep their places."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("khNaaiiuq| .9ಕಾ್ಂರ\x00\x05\u200d😀") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    texts[3:3] = [None, "", "k", "q", "ಂ", "ಕ", "|", "|", "c", "hh", " ", "k" * 300]
    rules = {"typed": translit.typing(), "cleaned": text.cleaning(), "nasals": spelling._nasals(), "coded": codec._encoding(True, codec.KANNADA)}
    for rule in rules.values():
        alone = [pointwise.rewrite(pa.array([t], pa.string()), rule)[0].as_py() for t in texts]
        assert alone[3] is None and alone[4] == ""
        for piece in (1, 64, 1 << 18):
            monkeypatch.setattr(pointwise, "PIECE", piece)
            assert pointwise.rewrite(pa.array(texts), rule).to_pylist() == alone
    both = pointwise.rewrite(pa.array(texts), rules["typed"], rules["cleaned"])
    assert both.equals(pointwise.rewrite(pointwise.rewrite(pa.array(texts), rules["typed"]), rules["cleaned"]))
    assert pointwise.rewrite(pa.array([], pa.string()), rules["typed"]).to_pylist() == []


def test_control_and_private_characters_stay_as_typed(spark):
    for c in "\x03\x04\x05\x06\ue100":
        assert one(spark, f"k{c}a", translit.to_kannada("t")) == f"ಕ್{c}ಅ"


def _python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [")


def test_encoding_a_text_is_one_pass_of_a_worker(spark):
    """Typing, cleaning, encoding and naming share a worker; no lambda walks the symbols one by one."""
    df = catalog.QUERIES["b8_encode"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert _python_steps(df) == 1 and "lambda" not in plan


def test_symbol_indices_go_straight_into_the_explode(spark):
    plan = catalog.QUERIES["b13_symbol_indices"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(" in plan and "inline(" not in plan and "lambda" not in plan
