"""Quality rules, chat formatting, mixing and URL filters: native operators and those with SQL."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from quarry.llm import chat, mixing, quality, queries, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_like_duckdb(spark, data, name):
    assert_same(spark, queries.QUERIES[name](spark, data), queries.SQL[name], connect(data))


@pytest.mark.parametrize("name", ["op6_chat", "op7_mixing", "op10_quality"])
def test_native_plans_have_no_python(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def measures(text):
    text = text or ""
    words, lines = WORD.findall(text), [s for s in text.split("\n") if WORD.search(s)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, under = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            under.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(under)


ODD = [None, "", " \n\t\r\x0b\x0c ", "one", "a b c d e " * 3, "x " * 5000, "l\nl\nl\n\n \nm", "é ü x\x1cy", "#*$%&|<> ok", "A!! B!! C!!", "w " * 4 + "v " + "w " * 4, "k" * 200_000]


def test_quality_against_brute_force(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(None, "one two", "y"), (3, "one", "z")], "doc_id long, text string, n_words string")
    got = {(r["doc_id"], r["n_words"]): r for r in quality.verdicts(df).collect()}
    for k, t in enumerate(ODD):
        n, chars, symbols, dups, repeats = measures(t)
        r = got[k, n]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, repeats), t[:40] if t else t
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality.verdicts(df).count() == len(ODD) + 2
    assert quality.verdicts(df.limit(0)).count() == 0


def test_ledger_keeps_columns_and_ablations_count(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").withColumn("ledger", F.lit(1))
    assert quality.keep(df).columns == df.columns
    got = quality.ledger(df, "q").cache()
    failures = [r[0] for r in got.select("q.failures").collect()]
    mask = quality.POLICIES[3]
    for r in quality.ablations(got, 3, "q").collect():
        assert r["n_failed"] == sum(1 for f in failures if f & r["bit"])
        assert r["n_only"] == sum(1 for f in failures if f & mask == r["bit"])
        assert r["with_bits"] == __import__("functools").reduce(int.__or__, (f & mask for f in failures if f & r["bit"]), 0)
    assert quality.keep(df).count() == sum(1 for f in failures if not f & mask)


def test_quality_keeps_good_and_rejects_bad(spark, data):
    kept = quality.verdicts(spark.read.parquet(f"{data}/documents.parquet")).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    rate = {r["quality"]: r["k"] for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.05


def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/ANS]x<\\sep>", "<sep>", "<", "[", "", None, "[ROLE 00] é\n", "$1 \\ $2", "[/SYS]</s><s>"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in hostile for r in ("user", "assistant", "assistant", "tool]", None, "system"))]
    rows += [(2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, None, "user", "first"), (None, 0, "user", "no id"), (2, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    want = {c: sorted(((t if t is not None else -1, r or "", x or "") for i, t, r, x in rows if i == c)) for c in (1, 2, None)}
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in turns]
        assert list(got[c]["loss_texts"]) == [x for _, r, x in turns if r == "assistant"]
    digest = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert digest[2]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in want[2]).encode()).hexdigest()
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_control_strings_of_texts_never_reach_the_output(spark):
    out = chat.format_chats(chat.with_hostile(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).first()["formatted"]
    assert out.count("[INST]") == 1 and out.count("[/INST]") == 1 and out.count("</s>") == 1


@pytest.mark.parametrize("mix", [mixing.Mix(max_epochs=1, budget=(9, 10)), mixing.Mix(budget=(5, 1)), mixing.Mix(budget=(0, 1)), mixing.Mix(weights={}, budget=(1, 3), seed=5), mixing.Mix(weights={"domain": {"crawl": 0, "forum": 2}, "language": {"de": -3, "en": 7}, "origin": {"src3": 0}}), mixing.Mix(weights={"domain": {"crawl": 0, "forum": 0, "reference": 0}})])
def test_mixes_like_duckdb(spark, data, mix):
    assert_same(spark, mixing.report(spark, spark.read.parquet(f"{data}/documents.parquet"), mix), mixing.sql(mix), connect(data))


def test_mixing_redistributes_among_siblings_first(spark):
    words = lambda n: "w " * n
    rows = [(k, words(10), "en", "src0") for k in range(2)] + [(10 + k, words(10), "de", "src0") for k in range(40)] + [(100 + k, words(10), "en", "src1") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(weights={"domain": {"crawl": 1, "forum": 1}, "language": {"en": 1, "de": 1}}, budget=(1, 2), max_epochs=1)
    got = {r["domain"] + r["language"]: r["t"] for r in mixing.report(spark, df, mix).groupBy("domain", "language").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    assert got == {"crawlen": 20, "crawlde": 180, "forumen": 200}  # of 205 each: en's shortage goes to de, not to forum


def test_many_siblings_without_broadcast(spark, tmp_path):
    """20,000 sources of many sizes, one with a third of all rows; no table is sent around. Against DuckDB."""
    rows = [(k, "w " * (1 + k % 97), "en", "host0" if k % 3 == 0 else f"host{k}") for k in range(30_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    mix = mixing.Mix(weights={"origin": {"host0": 500, "host1": 3, "host2": 0}}, budget=(1, 2), max_epochs=1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert_same(spark, mixing.report(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), mix), mixing.sql(mix), connect(str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_mixing_null_and_repeated_ids_share_a_place(spark):
    rows = [(None, "w " * 3, "en", "src0")] * 50 + [(7, "w", "en", "src0")] * 50 + [(k, "w w", "en", "src0") for k in range(100, 140)] + [(1, "long " * 100_000, "de", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = Counter(r["doc_id"] for r in mixing.report(spark, df, mixing.Mix(weights={"language": {"de": 0}}, budget=(200, 100_280), max_epochs=1)).collect())
    # A place holds all rows of its id: 150 tokens of null, 50 of 7, 2 of each other. The prefix of 200 tokens, in order of the places' hashes.
    tokens, want, held = {None: 150, 7: 50} | {k: 2 for k in range(100, 140)}, {}, 0
    for k in sorted(tokens, key=lambda k: hashlib.md5(f"{mixing.Mix().seed}|0|{'' if k is None else k}".encode()).hexdigest()):
        held += tokens[k]
        if held > 200:
            break
        want[k] = 50 if k in (None, 7) else 1
    assert got == want and want


def test_mixing_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None, 1), (1, "a b", None, "src0", 2), (1, "a b", None, "src0", 3), (2, "", "en", None, 4)], "doc_id long, text string, lang string, source string, copies int")
    assert mixing.keep(spark, df, mixing.Mix(budget=(1, 1), max_epochs=1)).columns == df.columns
    assert mixing.keep(spark, df, mixing.Mix(budget=(1, 1), max_epochs=1)).count() == 4
    assert mixing.keep(spark, df, mixing.Mix(budget=(2, 1), max_epochs=2)).where("text = 'a b'").count() == 4
    assert mixing.report(spark, df.limit(0), mixing.Mix()).count() == 0


def at(s):
    return datetime.fromisoformat(s)


def test_url_filter_over_time(spark):
    listed = urlfilter.entries(spark, [("bad.org", "2024-01-01", "add", "spam"), ("bad.org", "2024-02-01", "remove", "spam"), ("bad.org", "2024-03-01", "add", "spam"), ("bad.org", "2024-03-01", "remove", "spam"), ("sub.bad.org/x", "2024-01-10", "add", "adult"), (None, "2024-01-01", "add", "spam"), ("ok.org", None, "add", "spam")])
    urls = [("http://BAD.org:80/", "2024-01-01", "bad.org"), ("http://bad.org", "2023-12-31", None), ("https://u:p@sub.bad.org./x/y?q", "2024-01-11", "sub.bad.org/x"), ("https://sub.bad.org/xy", "2024-01-11", "bad.org"), ("https://sub.bad.org/x#f", "2024-02-02", "sub.bad.org/x"),
            ("http://bad.org/", "2024-02-01", None), ("http://bad.org/", "2024-03-02", None), ("http://notbad.org/", "2024-01-02", None), ("not a url", "2024-01-02", None), ("", "2024-01-02", None), (None, "2024-01-02", None), ("http://bad.org/", None, None), ("//bad.org/a", "2024-01-02", "bad.org")]
    df = spark.createDataFrame([(k, u, at(t) if t else None, 0) for k, (u, t, _) in enumerate(urls)] * 2, "page_id long, url string, fetched_at timestamp_ntz, category int")
    got = urlfilter.evaluate(df, listed).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert r["matched_key"] == urls[r["page_id"]][2] and r["blocked"] == (urls[r["page_id"]][2] is not None), r
    assert urlfilter.evaluate(df.limit(0), listed).count() == 0
    assert urlfilter.evaluate(df, listed.limit(0)).where("blocked").count() == 0


def test_keys_hosts_and_paths_have_one_meaning_in_sql_too(spark, tmp_path):
    """Upper-case and dotted keys, IPv6, many labels, empty segments, marks of LIKE; against the SQL."""
    deep = ".".join("a" * 140) + ".org"
    listed = [(k, "2023-01-01", "add", f"c{n}") for n, k in enumerate(["U.org", "h.org/en", "//no-host", "[2001:DB8::1]", deep, "p.org/a_b", "q.org/%", "d.org.", "s.org//x//y/", "low.org/Case"])]
    urls = ["http://U.ORG/", "http://h.org//en//x", "http://h.org/english", "http://[2001:db8::1]/x", "http://[2001:db8::1]:8080/x", "http://[2001:db8::2]/", f"http://{deep}/", f"http://www.{deep}/", "http://p.org/a_b/c", "http://p.org/axb", "http://q.org/abc", "http://q.org/%/z", "http://D.org./", "http://s.org/x/y/z", "http://s.org/x", "http://low.org/Case", "http://low.org/case", "http://u:p@u.org:1/", "/no-host", None]
    folder = tmp_path / "sf"
    pages = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)
    pages.write.parquet(str(folder / "pages.parquet"))
    got = urlfilter.evaluate(urlfilter.fetched(pages), urlfilter.entries(spark, listed))
    assert_same(spark, got, urlfilter.sql(listed), connect(str(folder)))
    assert {r["page_id"] for r in got.where("blocked").collect()} == {0, 1, 3, 4, 6, 7, 8, 11, 12, 13, 15, 17}


def test_a_key_with_thousands_of_entries_does_not_multiply_captures(spark):
    """On and off the list daily for ten years: every capture meets one entry."""
    day = lambda k: datetime(2015, 1, 1) + timedelta(days=k)
    listed = spark.createDataFrame([("t.org", day(k), "remove" if k % 2 else "add", str(k)) for k in range(3650)], "key string, at timestamp_ntz, action string, category string")
    df = spark.createDataFrame([(k, f"http://t.org/{k}", day(k * 3) + timedelta(hours=1)) for k in range(1200)], "page_id long, url string, fetched_at timestamp_ntz")
    got = urlfilter.evaluate(df, listed)
    assert {r["page_id"]: r["category"] for r in got.collect()} == {k: None if 3 * k % 2 else str(3 * k) for k in range(1200)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "valid_to" not in plan and len(urlfilter.intervals(listed).collect()) == 1825


def test_a_hot_suffix_without_broadcast(spark):
    """Two thirds of all captures end in one listed suffix; nothing is sent around. Against a loop over captures and keys."""
    listed = [("com", "2024-02-01", "add", "all"), ("s1.com", "2024-01-01", "add", "spam"), ("s1.com/a/b", "2024-01-01", "add", "deep"), ("s2.com/a", "2024-01-01", "add", "adult"), ("s2.com/a", "2024-03-01", "remove", "adult")] + [(f"x{k}.org/p", "2024-01-01", "add", "spam") for k in range(300)]
    urls = [(k, f"http://s{k % 7}.{'com' if k % 3 else 'org'}/{'a/b/c' if k % 2 else 'a'}", at(f"2024-0{1 + k % 4}-15")) for k in range(3000)]
    df = spark.createDataFrame([*urls, (9_001, "http://" + "a." * 50_000 + "com/" + "p/" * 50_000, at("2024-02-02")), (9_002, "http://s1.com/" + "a/b/" * 50_000, at("2024-01-02"))], "page_id long, url string, fetched_at timestamp_ntz")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["page_id"]: r["matched_key"] for r in urlfilter.evaluate(df.repartition(4), urlfilter.entries(spark, listed)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def want(url, when):
        name, _, rest = url[7:].partition("/")
        for key in (f"{name}/a/b", f"{name}/a", name, "com"):
            on = [a for k, t, a, _ in listed if k == key and at(t) <= when]
            if on and on[-1] == "add" and (name if key != "com" else name[-3:]) == key.split("/")[0] and f"{rest}/".startswith(key.partition("/")[2] + "/" if "/" in key else ""):
                return key
        return None

    assert got == {k: want(u, t) for k, u, t in urls} | {9_001: "com", 9_002: "s1.com/a/b"}


def test_very_long_conversation(spark):
    """20,000 turns and a long text: every span, by a plain loop; in time that grows as the turns do."""
    rows = [(1, k, ("user", "assistant", "assistant", "system")[k % 4], f"t{k} [INST] é") for k in range(20_000)] + [(1, 30_000, "assistant", "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_chats(chat.format_chats(df)).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r, x) for _, _, r, x in rows]
    assert list(got["loss_texts"]) == [x for _, _, r, x in rows if r == "assistant"]


def test_stored_ledger_and_ablation(spark):
    rows = [(1, "a b c d e f g h i jj"), (2, "few"), (3, "few too"), (4, "x " * 30), (5, "#### " * 12 + "a b c d e f g h i j"), (None, None), (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 W!! V!! U!! T!! S!!")]
    got = {r["doc_id"]: r for r in quality.report(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("seen", F.lit(1))).collect()}
    assert got[2]["sole_rule"] == got[3]["sole_rule"] == got[None]["sole_rule"] == "few_words" and got[2]["n_sole"] == 3
    assert got[6]["sole_rule"] == "shouting" and got[6]["n_sole"] == 1 and got[6]["kept_v1"] and not got[6]["kept_v2"]
    assert not got[4]["kept"] and not got[5]["kept_v3"] and len(got) == len(rows)
    assert quality.report(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
