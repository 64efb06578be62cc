import datetime as dt
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as tx
from tidewell.operators import editorial, evidence, filters, health, jobs, keys, runs, select
from tidewell.sources import sinks, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "minutes"), [("15 minutes", 15), ("every 6 hours", 360), ("daily", 1440), ("weekly", 10080), ("2.5 hours", 150), ("7", 15), ("37.5", 38), ("36.5", 36), ("", 1440), ("3 hrs", 180)])
def test_cadence(spark, text, minutes):
    assert one(spark, tx.cadence_minutes(F.lit(text))) == minutes


@pytest.mark.parametrize(("label", "primary", "discovery", "tier"), [("A", False, False, "A"), ("B", True, False, "A"), ("D", True, False, "D"), ("3-primary", False, False, "A"), ("3-regulatory", False, False, "A"), ("2-discovery", False, False, "C"), ("x", False, True, "C"), ("corporate", False, False, "B"), ("social", False, False, "D"), ("?", False, False, None)])
def test_tiers(spark, label, primary, discovery, tier):
    assert one(spark, tx.source_tier(F.lit(label), F.lit(primary), F.lit(discovery))) == tier


def test_amounts_and_numbers(spark):
    text = "raised US$1.5 million and 20m EUR, about £3bn; again $1,500,000, 12% of 4,000"
    found = {(str(a["amount"]).rstrip("0").rstrip("."), a["currency"]) for a in one(spark, tx.amounts(F.lit(text)))}
    assert found == {("1500000", "USD"), ("20000000", "EUR"), ("3000000000", "GBP")}
    assert {"12%", "4000", "1500000"} <= set(one(spark, tx.numbers(F.lit(text))))


@pytest.mark.parametrize(("raw", "url"), [("HTTPS://Example.COM:443//a//b?b=2&utm_source=x&a=1#f", "https://example.com/a/b?a=1&b=2"), ("https://u@example.com/", None), ("/relative", None), ("http://a.example:8080", "http://a.example:8080/")])
def test_canonical_urls(spark, raw, url):
    assert one(spark, tx.canonical_url(F.lit(raw))) == url


def test_revision_hash_sees_what_a_reader_sees(spark):
    h = lambda t, b: one(spark, tx.revision_hash(F.lit(t), F.lit(b)))
    assert h("A  title ", "x\n\n y ") == h("A title", "x\ny\n") != h("A title", "x\nz")


def test_guards(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, filters.inside_hour(at("2026-08-25 14:00:00"), "America/New_York", 10))
    assert not one(spark, filters.inside_hour(at("2026-01-25 14:00:00"), "America/New_York", 10))
    days = [one(spark, filters.inside_send_window(at(f"2026-08-{d} 14:05:00"), "America/New_York", 10, 30)) for d in range(24, 31)]
    assert days == [True, False, True, False, True, False, False]
    now = at("2026-08-25 14:00:00")
    assert one(spark, filters.window_start(now, at("2026-08-25 13:00:00"), F.lit(True))) == dt.datetime(2026, 8, 17, 14)
    assert one(spark, filters.window_start(now, F.lit(None).cast("timestamp"), F.lit(False))) == dt.datetime(2026, 8, 21, 14)


@pytest.mark.parametrize("address", ["127.0.0.1", "10.1.2.3", "192.168.0.1", "169.254.1.1", "172.20.0.1", "0.0.0.0", "224.0.0.1", "100.64.0.1", "256.1.1.1", "::1"])
def test_addresses_that_are_not_public(spark, address):
    assert not one(spark, filters.public_ipv4(F.lit(address)))
    assert one(spark, filters.public_ipv4(F.lit("93.184.216.34")))


def test_merge_replaces_whole_rows_and_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    source = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = keys.merge(target, source, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x"), (2, "c", None), (3, "d", None)]
    assert sorted(map(tuple, keys.merge(once, source, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    for bad in ([(2, "c"), (2, "d")], [(None, "c")]):
        with pytest.raises(Exception, match="duplicate key|blank key"):
            keys.merge(target, spark.createDataFrame(bad, "k int, v string"), ["k"]).collect()
    with pytest.raises(ValueError, match="missing"):
        keys.merge(target, source, ["z"])


def test_append_absent_numbers_new_keys(spark):
    target = spark.createDataFrame([("R007", "a@x")], "id string, email string")
    new = spark.createDataFrame([(1, "b@x"), (2, "a@x"), (3, "b@x"), (4, "c@x")], "seq int, email string")
    assert [(r["id"], r["email"]) for r in keys.append_absent(target, new, "email", "id", "R", "seq").orderBy("id").collect()] == [("R008", "b@x"), ("R009", "c@x")]


def test_append_absent_goes_on_beyond_three_digits(spark):
    target = spark.createDataFrame([("R0999", "a@x"), ("R998", "z@x")], "id string, email string")
    new = spark.createDataFrame([(k, f"n{k}@x") for k in range(3)], "seq int, email string")
    assert [r["id"] for r in keys.append_absent(target, new, "email", "id", "R", "seq").orderBy("seq").collect()] == ["R1000", "R1001", "R1002"]


def test_repairs_and_completions(spark):
    answers = spark.createDataFrame([("a", 1, ["X"]), ("a", 2, []), ("b", 1, []), ("b", 2, ["Y"]), ("c", 1, ["X"]), ("c", 2, ["Y"]), ("c", 3, []), ("d", 1, ["X"])], "k string, turn int, codes array<string>")
    out = {r["k"]: (r["turn"], r["accepted"]) for r in evidence.after_repair(answers, "k").collect()}
    assert out == {"a": (2, True), "b": (1, True), "c": (2, False), "d": (1, False)}
    tries = spark.createDataFrame([("a", 1, 429, None), ("a", 2, 200, '{"n": 1}'), ("a", 3, 200, '{"n": 2}'), ("b", 1, 200, "{"), ("b", 2, 200, '{"m": 1}')], "k string, attempt int, status int, body string")
    out = {r["k"]: (r["answer"] and r["answer"]["n"], r["attempts"]) for r in evidence.completions(tries, "k", "n int").collect()}
    assert out == {"a": (1, 3), "b": (None, 2)}


def test_quotes_of_any_length(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g"), (2, "b c"), (3, ""), (4, "xa b c d e f gy")], "k int, t string")
    quotes = spark.createDataFrame([("one", "g"), ("two", "b c"), ("six", "a b c d e f"), ("none", ""), ("long", "a b c d e f g h")], "q string, x string")
    assert sorted(map(tuple, evidence.quoted(texts, quotes, "k", "t", "q", "x").collect())) == [(1, "one"), (1, "six"), (1, "two"), (2, "two"), (4, "two")]


def test_results_in_order_of_their_jobs(spark):
    results = spark.createDataFrame([("b", 1), ("a", 2), ("b", 0)], "job string, n int")
    order = spark.createDataFrame([("a", 5), ("b", 3)], "job string, seq int")
    assert [tuple(r) for r in jobs.in_order(results, order, "job", "seq", "n").collect()] == [("b", 0), ("b", 1), ("a", 2)]


def test_digest_rows_and_previews(spark, tmp_path):
    runs_ = spark.createDataFrame([("r1", {"lead": 2, "deal_tape": 1}, "x" * 60_000), ("r2", None, "{}")], "run_id string, section_counts map<string,int>, edition_json string")
    rows = {r["run_id"]: r for r in sinks.digest_rows(runs_).collect()}
    assert rows["r1"]["section_counts"] == '{"deal_tape":1,"lead":2}' and rows["r1"]["edition_json"].startswith("gzip:") and rows["r2"]["edition_json"] == "{}"
    bodies = spark.createDataFrame([("email.html", "<p>a</p>\n<p>b</p>"), ("email.txt", "a")], "name string, body string")
    sinks.write_previews(bodies, f"file://{tmp_path}/out")
    assert {(r["name"], r["value"]) for r in spark.read.text(f"file://{tmp_path}/out", wholetext=True).collect()} == {("email.html", "<p>a</p>\n<p>b</p>\n"), ("email.txt", "a\n")}


def test_compare_and_set_stops_when_a_row_changed(spark):
    target = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    ok = spark.createDataFrame([(2, None, "z")], "k int, expected_v string, new_v string")
    assert sorted(map(tuple, keys.compare_and_set(target, ok, "k", ["v"]).collect())) == [(1, "a"), (2, "z")]
    with pytest.raises(Exception, match="row changed"):
        keys.compare_and_set(target, spark.createDataFrame([(1, "b", "z")], "k int, expected_v string, new_v string"), "k", ["v"]).collect()


def test_anti_join_chain_equals_or(spark):
    rng = random.Random(2)
    events = [(i, str(rng.randint(0, 20)), rng.choice(["", "h1", "h2", None, "h3"])) for i in range(60)]
    history = [(str(rng.randint(0, 20)), rng.choice(["", "h2", None])) for _ in range(6)]
    out = keys.unpublished(spark.createDataFrame(events, "event_id int, cand string, hash string"), spark.createDataFrame(history, "raw string, hash string"), {"cand": ["raw"], "hash": ["hash"]})
    ids, hashes = {r for r, _ in history}, {h for _, h in history if h}
    assert {r["event_id"] for r in out.collect()} == {i for i, c, h in events if c not in ids and h not in hashes}


def selection_in_order(rows: list[dict], passes: list[tuple], per_job: int = 2) -> list[tuple[int, int]]:
    """The same by visiting rows one by one: (pos, pass) of the chosen ones in order. passes: (predicate, most, more, per_source)."""
    chosen: list[dict] = []
    numbers: list[int] = []
    used = lambda field, r: sum(c[field] == r[field] for c in chosen)
    for number, (wanted, most, more, per_source) in enumerate(passes):
        target = min(most, len(chosen) + (most if more is None else more))
        lists: dict[str, dict[str, list[dict]]] = {x: {} for x in select.LANE_ORDER}
        for r in sorted(filter(wanted, rows), key=lambda r: r["pos"]):
            lists[r["lane"]].setdefault(r["source_id"], []).append(r)
        depth = 0
        while any(len(q) > depth for by in lists.values() for q in by.values()):
            moved = True
            while moved and len(chosen) < target:
                moved = False
                for by in lists.values():
                    fit = (q[depth] for q in by.values() if len(q) > depth)
                    fit = (r for r in fit if not used("url", r) and not used("hash", r) and used("job", r) < per_job and used("source_id", r) < per_source)
                    if len(chosen) < target and (r := next(fit, None)):
                        chosen.append(r)
                        numbers.append(number)
                        moved = True
            depth += 1
    return [(r["pos"], n) for r, n in zip(chosen, numbers, strict=True)]


def _pool(rng: random.Random, n: int, sources: int, values: int) -> list[dict]:
    return [
        {"pos": i, "source_id": (s := f"s{rng.randint(0, sources)}"), "job": f"{s}-{rng.randint(0, 1)}", "lane": rng.choice(select.LANE_ORDER), "url": f"u{rng.randint(0, values)}", "hash": f"h{rng.randint(0, 3 * values)}", "web": rng.random() < 0.3, "debt": rng.random() < 0.3}
        for i in range(n)
    ]


def _passes(n: int, web: int, debt: int) -> list[tuple]:
    return [(lambda r: not r["web"] and not r["debt"], n - web - debt, None, 1), (lambda r: r["debt"] and not r["web"], n - web, debt, 1), (lambda r: r["web"], n, web, 1), (lambda r: True, n, None, 1), (lambda r: True, n, None, 2)]


def test_rotation_in_rounds_equals_the_sequential_rule():
    """5,000 random pools with repeated URLs and contents; rounds offer few rows at first, so that they stop and go on everywhere."""
    for seed in range(5000):
        rng = random.Random(seed)
        rows, n, offer, deep = _pool(rng, rng.randint(0, 40), rng.randint(1, 8), rng.randint(3, 30)), rng.randint(1, 25), rng.randint(1, 5), rng.randint(1, 3)
        passes, selection = _passes(n, min(2, n), min(1, n - min(2, n))), select.Selection(2)
        for number, (wanted, most, more, per_source) in enumerate(passes):
            target, step = min(most, len(selection.rows) + (most if more is None else more)), select.Pass(None, most, more, per_source)
            at, depth, seen, first = select._State(), deep, defaultdict(int), {}
            pool = []
            for r in sorted(filter(wanted, rows), key=lambda r: r["pos"]):
                by = (r["lane"], r["source_id"])
                pool.append(r | {"key": r["pos"], "source": r["source_id"], "depth": seen[by], "first": first.setdefault(by, r["pos"])})
                seen[by] += 1
            said = ""
            while len(selection.rows) < target and said != "done":
                full = {j for j, k in selection.jobs.items() if k >= 2} | {s for s, k in selection.sources.items() if k >= per_source} | selection.urls | selection.hashes
                left = sorted((r for r in pool if at.depth <= r["depth"] <= depth and (r["depth"] == depth or not full & {r["job"], r["source"], r["url"], r["hash"]})), key=lambda r: (r["depth"], r["first"]))
                offered = {x: deque([r for r in left if r["lane"] == x][:offer]) for x in select.LANE_ORDER}
                whole = {x: len(q) < offer for x, q in offered.items()}
                said = select._rotate(offered, whole, depth, at, selection, number, step, target)
                depth = depth * 8 if said == "deeper" else depth
        assert selection.rows == selection_in_order(rows, passes), seed


@pytest.mark.parametrize("seed", range(3))
def test_balanced_selection_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = _pool(rng, (400, 90, 30)[seed], (5, 30, 4)[seed], (200, 20, 9)[seed])
    passes = [select.Pass(p, *rest) for p, (_, *rest) in zip((~F.col("web") & ~F.col("debt"), F.col("debt") & ~F.col("web"), F.col("web"), F.lit(True), F.lit(True)), _passes(20, 4, 2), strict=True)]
    got = select.balanced(spark.createDataFrame(rows), passes, F.struct("pos"), "pos", "url", "hash", "job", offer=5, deep=3).orderBy("place").select("pos", "pass_no").collect()
    assert [tuple(r) for r in got] == selection_in_order(rows, _passes(20, 4, 2))


def test_nothing_to_select_from(spark):
    none = spark.createDataFrame([], "pos long, source_id string, job string, lane string, url string, hash string")
    assert select.balanced(none, [select.Pass(F.lit(True), 9)], F.struct("pos"), "pos", "url", "hash", "job").collect() == []


def test_streaks(spark):
    rows = [(1, i, ok) for i, ok in enumerate([True, False, False, True, False, False, False, True])]
    out = health.streaks(spark.createDataFrame(rows, "k int, seq int, ok boolean").withColumn("ts", F.timestamp_seconds("seq")), "k", ["seq"], F.col("ok"), "ts").orderBy("seq").collect()
    assert [r["consecutive_failures"] for r in out] == [0, 1, 2, 0, 1, 2, 3, 0]
    assert [r["status"] for r in out][6] == "QUARANTINED" and out[5]["last_success_at"] == out[3]["ts"]


def test_expansion_keeps_a_job_for_a_missing_dimension(spark):
    src = spark.createDataFrame([("a", True, "https://x/{cik}"), ("b", False, "https://y"), ("c", True, "https://z")], "source_id string, active boolean, url string")
    none = spark.createDataFrame([], "value string")
    out = {r["source_id"]: r for r in jobs.expand(src, {"cik": ((r"\{cik\}",), none)}).collect()}
    assert set(out) == {"a", "c"} and out["a"]["configuration_errors"] == ["MISSING_CIK"] and out["c"]["configuration_errors"] == []


def test_evidence_codes(spark):
    text = F.lit("Acme closed a $20 million credit line with Big Bank on Monday.")
    base = dict(candidate_id="c", expected_id="c", decision="KEEP", section="deal_tape", event_type="loan", discovery_only=False, primary_source=True, source_class="A", confidence=90, borrower="Acme", rate="", maturity="", event_date="")
    good = spark.range(1).select(
        *(F.lit(v).alias(k) for k, v in base.items()),
        F.array(F.struct(F.lit("f").alias("fact_id"), F.lit("c").alias("claim"), F.lit("closed a $20 million credit line").alias("exact_quote"), F.lit("https://a").alias("source_url"))).alias("facts"),
        F.array(F.struct(F.lit("total_commitment").alias("kind"), F.lit(2e7).alias("amount"), F.lit("USD").alias("currency"), F.lit("f").alias("fact_id"), F.lit("$20 million").alias("source_text"))).alias("amounts"),
        F.array(F.lit("https://a")).alias("approved_urls"), F.array(F.lit("Big Bank")).alias("lenders"), F.array(F.lit("Acme")).alias("entities"), F.lit(None).cast("timestamp").alias("published_at"),
    )
    codes = lambda df: df.select(evidence.evidence_codes(text).alias("x")).first()["x"]
    assert codes(good) == []
    assert codes(good.withColumn("discovery_only", F.lit(True))) == ["DISCOVERY_ITEM_CANNOT_BE_KEPT"]
    assert codes(good.withColumn("borrower", F.lit("Other Co"))) == ["DEAL_TAPE_PARTY_NOT_IN_SOURCE"]
    assert codes(good.withColumn("amounts", F.transform("amounts", lambda a: a.withField("amount", F.lit(3e7))))) == ["AMOUNT_NOT_SOURCE_DERIVED"]
    assert codes(good.withColumn("facts", F.transform("facts", lambda f: f.withField("exact_quote", F.lit("never said"))))) == ["AMOUNT_TEXT_NOT_IN_FACT", "QUOTE_NOT_IN_SOURCE"]
    event = evidence.events_of(good.withColumn("codes", evidence.evidence_codes(text))).first()
    assert int(event["total_commitment"]) == 20_000_000 and event["currency"] == "USD" and event["event_codes"] == []


STORY = "draft_id int, seq int, section string, event_id string, headline string, dek string, why_it_matters string, fact_ids array<string>, source_ids array<string>, entities array<string>"
EVENT = "draft_id int, event_id string, section string, entities array<string>, fact_ids array<string>, source_ids array<string>, sources array<string>, facts array<struct<fact_id:string,claim:string,exact_quote:string>>"
ACME = (1, "e", "ai_radar", ["Acme", "Beta Bank"], ["f", "g"], ["s", "t"], ["s"], [("f", "Acme grew 12%", "It grew in May"), ("g", "of $3 million", "")])


def _story(**x):
    base = dict(draft_id=1, seq=1, section="ai_radar", event_id="e", headline="Acme \u2014 grows", dek="Acme grew 12%.", why_it_matters="It matters.", fact_ids=["f"], source_ids=["s"], entities=["Acme"])
    return tuple((base | x).values())


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, []),
        ({"section": "lead"}, []),
        ({"section": "deal_tape"}, ["SECTION_MISMATCH"]),
        ({"event_id": "x"}, ["UNKNOWN_EVENT_ID"]),
        ({"headline": "Acme: grows"}, ["HEADLINE_FORMAT_INVALID"]),
        ({"headline": "Beta Bank \u2014 lends"}, ["COPY_ENTITY_NOT_DECLARED"]),
        ({"headline": "acme \u2014 grows"}, ["HEADLINE_COMPANY_NOT_SOURCE_ENTITY"]),
        ({"dek": "See www.acme.example, 15%"}, ["MODEL_COPY_CONTAINS_URL_OR_EMAIL", "NUMBER_NOT_IN_SELECTED_FACTS"]),
        ({"dek": "It grew 3 million."}, ["NUMBER_NOT_IN_SELECTED_FACTS"]),
        ({"dek": "It grew 3 million.", "fact_ids": ["g"]}, []),
        ({"fact_ids": []}, ["NUMBER_NOT_IN_SELECTED_FACTS", "UNSUPPORTED_FACT_ID"]),
        ({"source_ids": ["t"]}, ["SOURCE_CITATION_MISSING"]),
        ({"source_ids": None}, ["UNSUPPORTED_SOURCE_ID"]),
        ({"entities": ["Acme", "Gamma"]}, ["DECLARED_ENTITY_NOT_IN_COPY", "UNSUPPORTED_ENTITY"]),
        ({"dek": "A paradigm shift for it."}, ["BANNED_OR_SLOPPY_COPY"]),
        ({"dek": "It met Zeta-Co and OpenThing."}, ["POSSIBLE_INVENTED_ENTITY", "POSSIBLE_INVENTED_ENTITY_TOKEN_OPENTHING", "POSSIBLE_INVENTED_ENTITY_TOKEN_ZETA"]),
    ],
)
def test_story_codes(spark, change, want):
    out = editorial.judged(spark.createDataFrame([_story(**change)], STORY), spark.createDataFrame([ACME], EVENT)).first()
    assert out["codes"] == want


def test_an_annotator_repairs_once_and_may_fail(spark):
    """Candidates 0 to 9 of 12: 3 fails and is back in the second turn, 4 fails twice, 5 is repaired, 6 is not; no more tasks than calls at once."""

    def annotator(request):
        k, again = int(request["candidate_id"]), bool(request["codes"])
        if k == 4 or (k == 3 and not again):
            raise TimeoutError("no answer")
        return f"{request['title']} {'repaired' if again else 'bad' if k in (5, 6) else 'good'}{' bad' if k == 6 else ''}"

    check = lambda a: a.withColumn("codes", F.when(F.contains("answer", F.lit("bad")), F.array(F.lit("BAD"))).otherwise(F.array().cast("array<string>")))
    rows = spark.createDataFrame([(f"{k:02d}", f"t{k}") for k in range(12)], "candidate_id string, title string")
    out = {int(r["candidate_id"]): (r["turn"], r["answer"], r["accepted"], r["codes"]) for r in evidence.annotated_by(rows, "candidate_id", annotator, check, 10, 3).collect()}
    assert len(out) == 10 and out[0] == (1, "t0 good", True, []) and out[3] == (2, "t3 repaired", True, [])
    assert out[4][1:] == (None, False, ["CALL_FAILED"]) and out[5] == (2, "t5 repaired", True, []) and out[6] == (2, "t6 repaired bad", False, ["BAD"])
    assert evidence.asked(rows.withColumn("codes", F.array()), "candidate_id", annotator, 1, 3).rdd.getNumPartitions() <= 3


def test_a_second_story_of_an_event_goes(spark):
    stories = [_story(seq=2), _story(seq=1), _story(section="lead", seq=9)]
    out = editorial.judged(spark.createDataFrame(stories, STORY), spark.createDataFrame([ACME], EVENT)).collect()
    assert {(r["section"], r["seq"]): r["codes"] for r in out} == {("lead", 9): [], ("ai_radar", 1): ["DUPLICATE_EVENT"], ("ai_radar", 2): ["DUPLICATE_EVENT"]}


def _edition(spark, stories, events, **draft):
    base = dict(draft_id=1, quiet=False, repaired=False, kicker="Daily", headline="Acme grows 12%", deck="News") | draft
    held = spark.createDataFrame([tuple(base.values())], "draft_id int, quiet boolean, repaired boolean, kicker string, headline string, deck string")
    events = spark.createDataFrame(events, EVENT)
    return editorial.edition_codes(held, editorial.judged(spark.createDataFrame(stories, STORY), events), events).first()


def test_editions_as_a_whole(spark):
    more = [(1, f"e{k}", "ai_radar", [f"Name{k}"], ["f"], ["s"], ["s"], [("f", "c", "q")]) for k in range(8)]
    out = _edition(spark, [_story()], [ACME])
    assert (out["accepted"], out["codes"], out["headline"], out["stories"], out["words"]) == (True, [], "Acme grows 12%", 1, 12)
    # Too few of many; a repaired draft may have lost some of its stories, but not all, and not where none had a fault.
    assert _edition(spark, [_story()], [ACME, *more])["codes"] == ["STORY_FLOOR_NOT_MET"]
    bad = _story(seq=2, event_id="x")
    assert _edition(spark, [_story(), bad], [ACME, *more])["codes"] == ["STORY_FLOOR_NOT_MET"]
    kept = _edition(spark, [_story(), bad], [ACME, *more], repaired=True)
    assert (kept["accepted"], kept["codes"], kept["story_codes"], kept["stories"]) == (True, [], ["UNKNOWN_EVENT_ID"], 1)
    assert _edition(spark, [_story()], [ACME, *more], repaired=True)["codes"] == ["STORY_FLOOR_NOT_MET"]
    assert not _edition(spark, [_story(), bad], [ACME])["accepted"] and not _edition(spark, [bad], [ACME], repaired=True)["accepted"]
    # What the edition says of itself: names of others and foreign numbers are written over; the words of the ban are not.
    assert _edition(spark, [_story()], [ACME, more[0]], deck="With Name0.")["headline"] == "Acme \u2014 grows"
    assert _edition(spark, [_story()], [ACME], headline="Acme grows 13%")["deck"] == editorial.PLAIN_DECK
    assert _edition(spark, [_story()], [ACME], kicker="Exciting times")["codes"] == ["BANNED_EDITION_COPY"]
    assert _edition(spark, [bad], [ACME], headline="7")["headline"] == editorial.PLAIN_HEADLINE
    assert _edition(spark, [_story()], [ACME], quiet=True)["codes"] == ["QUIET_DAY_HAS_STORIES"]
    assert _edition(spark, [_story(section="lead"), _story(section="lead", seq=2)], [ACME])["codes"] == ["SECTION_CAP_EXCEEDED"]
    none = _edition(spark, [_story(draft_id=2)], [ACME], quiet=True, headline="Quiet")
    assert (none["accepted"], none["stories"], none["codes"]) == (True, 0, [])
    assert _edition(spark, [_story(draft_id=2)], [ACME])["codes"] == ["NON_QUIET_DAY_HAS_NO_STORIES"]


@pytest.mark.parametrize("digits", [24, 25, 40, 400])
def test_long_numbers_are_no_error(spark, digits):
    n = "9" * digits
    text = F.lit(f"${n} trillion and {n}.50 million% or USD {n}, 0.5k, 00012, 1,000.10 USD")
    row = spark.range(1).select(tx.numbers(text).alias("n"), tx.amounts(text).alias("a")).first()
    assert row["n"] == sorted([n + "0" * 12, n + "500000%", n, "500", "12", "1000.1"])
    fits = [(str(a["amount"]), a["currency"]) for a in row["a"]]
    assert ("1000.100000", "USD") in fits and len(fits) == (2 if digits <= 32 else 1)


def test_scans(spark):
    raw = spark.createDataFrame([("1", " a "), (" ", "")], ["Source ID", "Max Items"])
    assert [r.asDict() for r in tables.scan(raw).collect()] == [{"source_id": "1", "max_items": "a"}]
    with pytest.raises(ValueError, match="header"):
        tables.scan(raw.toDF("A b", "a_B"))
    with pytest.raises(Exception, match="secret"):
        tables.settings(spark.createDataFrame([("api_key", "x")], "setting string, value string")).collect()
    with pytest.raises(Exception, match="repeated setting"):
        tables.settings(spark.createDataFrame([("A", "x"), ("a ", "y")], "setting string, value string")).collect()


def test_conflicting_payloads_are_an_error(spark):
    with pytest.raises(Exception, match="conflicting"):
        runs.one_fingerprint(spark.createDataFrame([(1, "a"), (1, "b")], "k int, p string"), "k", "p").collect()


def test_envelopes():
    text = "é" * 60_000
    packed = sinks.envelope(text)
    assert packed.startswith("gzip:") and sinks.opened(packed) == text and sinks.envelope("short") == "short"
    with pytest.raises(ValueError, match="envelope"):
        sinks.opened(packed.replace(packed[5:9], "0000", 1))


def test_labels_of_one_row_are_settled_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, ["b", "A", "", "a", None, "B", "c"]), (2, None), (3, ["x"]), (3, ["X", "y"])], "e int, w array<string>")
    once = lambda df: keys.labels_once(df, "e", ["w"], F.lower)
    alone = once(rows.where("e < 3"))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, alone.collect())) == [(1, 1, "b"), (1, 2, "A"), (1, 3, "c")]
    both = sorted(map(tuple, once(rows).collect()))
    assert both[:3] == [(1, 1, "b"), (1, 2, "A"), (1, 3, "c")] and [(e, n, x.lower()) for e, n, x in both[3:]] == [(3, 1, "x"), (3, 2, "y")]


def test_a_source_has_one_share_for_all_lanes(spark):
    rows = spark.createDataFrame([(1, "s", "ai"), (2, "s", "venture_debt"), (3, "s", "competitor_deposit"), (4, "t", "ai"), (5, "t", "ai")], "pos int, source_id string, lane string")
    assert [r["pos"] for r in select.round_robin(rows, 9, 2).collect()] == [1, 4, 2, 5]


def test_lanes_take_turns_with_a_source_for_all_lanes():
    from tidewell.plans import registry

    assert "source as source_id" in registry.SQL["lane_round_robin"]


@pytest.mark.parametrize("sources", [0, 3, 25])
def test_lanes_offer_all_rows_of_the_sources_that_they_share(spark, tmp_path, sources):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tests.compare import same
    from tidewell.plans import registry

    rng, lanes = random.Random(sources), {"en": "venture_debt", "de": "competitor_deposit"}
    rows = [(1, "s", "fr"), (2, "s", "en"), (3, "s", "de"), (4, "t", "fr"), (5, "t", "fr")]
    if sources:
        rows = [(i, rng.choice([None, "", *(f"s{n}" for n in range(sources))]), rng.choice(["en", "de", "fr", None])) for i in rng.sample(range(1000), 150)]
    pq.write_table(pa.table(dict(zip(("doc_id", "source", "lang"), map(list, zip(*rows, strict=True)), strict=True))), tmp_path / "documents.parquet")
    pool = [{"pos": i, "source_id": s, "lane": lanes.get(x, "ai"), "url": i, "hash": i, "job": i} for i, s, x in rows]
    want = [i for i, _ in selection_in_order(pool, [(lambda r: True, 30, None, 2)])]
    assert sources or want == [2, 3, 4, 5]
    assert [r["doc_id"] for r in registry.QUERIES["lane_round_robin"](spark, str(tmp_path)).collect()] == want
    same(spark, registry.QUERIES["lane_round_robin"], registry.SQL["lane_round_robin"], str(tmp_path))
