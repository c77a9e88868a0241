"""Whole runs of the funnel: state, failures, waves, restarts and fingerprints from run to run."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from winnow.operators import funnel_ops, run_log
from winnow.operators.funnel_ops import Failover, PermanentError, Provider, offline_scorer
from winnow.operators.log import CacheLog, SeenLog
from winnow.plans import funnel
from winnow.plans.rules import Role, RulePack
from winnow.schema import conform

PACK = RulePack([Role("ops", 40, must_role=["operations"], titles_strong=["operations manager"], keywords_boost=["support"], keywords_penalize=["nights"])], remote=["remote"], entry=["junior"])


def postings(spark, rows):
    posts = spark.createDataFrame(rows, "id string, title string, company string, description string")
    url = F.concat(F.lit("https://hh.ru/vacancy/"), "id")
    return conform(posts.withColumn("source", F.when(F.col("company") == "hh", "hh.ru").otherwise("s")).withColumn("url", url))


ROWS = [("1", "Operations manager", "a", "remote support for junior"), ("2", "Operations manager!", "a", "remote support again"), ("3", "Cook", "b", "kitchen"), ("4", "Operations manager", "c", "support"), ("5", "Operations", "d", "")]


class World:
    """State, cache and log of a test."""

    def __init__(self, spark, folder, rows=ROWS, pages=()):
        self.spark, self.folder = spark, f"file://{folder}"
        self.posts, self.pages = postings(spark, rows), spark.createDataFrame(list(pages), "url string, text string")
        self.seen, self.cache = SeenLog(spark, f"{self.folder}/seen", 4), CacheLog(spark, f"{self.folder}/cache", 4)

    def run(self, name, ask, pack=PACK, **more):
        providers = [Provider("p", ask)] if callable(ask) else ask
        return funnel.run(self.posts, self.pages, self.seen, self.cache, pack, providers, "v1", F.timestamp_seconds(F.lit(1)), f"{self.folder}/log", name, **more)

    def state(self):
        return {r.id: r.prefilter_version for r in self.seen.read().collect()}


def test_runs(spark, tmp_path):
    w = World(spark, tmp_path)

    def failing(batch):  # inside, so that it travels to the workers by value
        raise TimeoutError("no answer")

    first = w.run("r1", failing)
    told = first.counters.first()
    assert first.delivered.count() == 0 and (told.unseen, told.prefiltered, told.failed_batches, told.unscored, told.cause) == (5, 2, 1, 2, "provider down")
    f = PACK.fingerprint()
    assert w.state() == {"2": f, "3": f, "5": f}  # the near-duplicate is a rejection too, what failed isn't marked

    second = w.run("r2", offline_scorer)  # only what failed comes up again
    told = second.counters.first()
    assert [r.id for r in second.delivered.collect()] == ["1", "4"] and (told.unseen, told.prefiltered, told.failed_batches, told.provider, told.switched) == (2, 2, 0, "p", 0)
    assert w.state() == {"1": None, "4": None, "2": f, "3": f, "5": f}
    assert {r.job_id: r.scoring_version for r in w.cache.read().collect()} == {"1": "v1", "4": "v1"}
    assert {(r.job_id, r.batch) for r in second.matches.collect()} == {("1", 0), ("4", 0)}
    assert [tuple(r)[:3] for r in second.checkpoints.collect()] == [(1, 1, 2)]
    assert w.run("r3", offline_scorer).counters.first().unseen == 0

    third = w.run("r4", offline_scorer, RulePack(PACK.roles, remote=["remote"]))  # another fingerprint: rejections are judged anew, verdicts aren't
    assert third.counters.first().unseen == 3


def test_cached_scores_are_verdicts(spark, tmp_path):
    w = World(spark, tmp_path)
    w.cache.append(spark.createDataFrame([("1", 90, "v1"), ("4", 91, "old")], "job_id string, score int, scoring_version string"))

    def failing(batch):
        raise TimeoutError("no answer")

    got = w.run("r1", failing)
    assert [(r.id, r.score) for r in got.delivered.collect()] == [("1", 90)] and w.state()["1"] is None and "4" not in w.state()


def test_whole_answered_batch_has_a_verdict(spark, tmp_path):
    """A posting that the answer leaves out isn't paid for again; one that it invents isn't delivered."""
    w = World(spark, tmp_path)

    def partial(batch):
        import json

        return json.dumps([{"id": "1", "score": "80"}, {"id": "other", "score": 99}, {"score": 3}])

    got = w.run("r1", partial)
    assert [r.id for r in got.delivered.collect()] == ["1"] and {i for i, v in w.state().items() if v is None} == {"1", "4"}


def test_enrichment_adds_the_page_and_rejects(spark, tmp_path):
    rows = [("1", "Operations manager", "hh", "Tallinn, support"), ("2", "Operations manager two", "hh", "Riga, support"), ("3", "Operations manager three", "c", "support"), ("4", "Operations manager four", "hh", "no page")]
    pages = [("https://hh.ru/vacancy/1?from=x", "long text of the page " * 20), ("https://hh.ru/vacancy/2", "nights " * 20), ("https://hh.ru/vacancy/9", "of none")]
    w = World(spark, tmp_path, rows, pages)
    records = []

    def asks(batch):
        import json

        return json.dumps([{"id": r["id"], "score": 60, "recommendation": r["record"]} for r in batch])

    strict = RulePack([Role("ops", 40, must_role=["operations"], titles_strong=["operations manager"], keywords_penalize=["nights"])])
    got = w.run("r1", asks, strict)
    records = {r.job_id: r.recommendation for r in got.matches.collect()}
    assert set(records) == {"1", "3", "4"} and "Tallinn, support" in records["1"] and "long text of the page" in records["1"]
    assert w.state() == {"1": None, "3": None, "4": None, "2": strict.fingerprint()}  # dropped by its page: a rejection
    h = got.health.first()
    assert (h.attempted, h.enriched, h.failed, h.healthy) == (3, 2, 1, True) and h.downloaded == len(pages[0][1]) + len(pages[1][1])
    kept, stats = funnel.enrich(funnel.triage(w.posts.withColumn("ordinal", -F.col("id").cast("int")), SeenLog(spark, f"file://{tmp_path}/none").read(), strict).candidates, w.pages, strict, "hh.ru", most=2)
    assert stats.first().attempted == 2 and "2" not in {r.id for r in kept.collect()}  # the first two of the input: 4 and 2


def many(n):
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    return [(f"{i:03d}", f"Operations manager {word(i)}", "a", "remote support") for i in range(n)]


def test_killed_run_goes_on(spark, tmp_path):
    """A run that dies between two waves: complete ones aren't asked again, the torn one is, results are whole."""
    w = World(spark, tmp_path, many(40))
    log = f"{tmp_path}/asked"
    open(log, "w").close()

    def scorer(batch):
        with open(log, "a") as f:
            f.write(" ".join(r["id"] for r in batch) + chr(10))
        return offline_scorer(batch)

    class Killed(Exception):
        pass

    put, calls = w.cache.append, []

    def dies(rows, name):
        calls.append(name)
        if name[1] == 3:  # the answers of this step are written, its scores and verdicts aren't
            raise Killed
        return put(rows, name)

    w.cache.append = dies
    with pytest.raises(Killed):
        w.run("r1", scorer, wave=3)
    held = {i for i, v in w.state().items() if v is None}
    assert len(held) == 20 and w.cache.read().count() == 20  # steps 0 to 2: 1 + 2 + 1 batches
    spark._jvm.org.apache.hadoop.fs.Path(f"{w.folder}/log/r1/answers-000003/_SUCCESS").getFileSystem(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{w.folder}/log/r1/answers-000003/_SUCCESS"), False)

    w.cache.append = put
    got = w.run("r1", scorer, wave=3)
    assert got.delivered.count() == 40 == len(w.state()) == w.cache.read().count() and got.checkpoints.count() == 8
    with open(log) as f:
        asked = f.read().split()
    assert sorted(set(asked)) == [f"{i:03d}" for i in range(40)] and len(asked) == 50  # two batches were torn
    w.run("r1", scorer, wave=3)
    with open(log) as f:
        assert len(f.read().split()) == 50


def test_dead_provider_is_met_once_a_wave(spark, tmp_path):
    """Four partitions: one request finds that a provider is out, no task of any wave asks it again."""
    w = World(spark, tmp_path, many(60))
    log = f"{tmp_path}/asked"
    open(log, "w").close()

    def out(batch):
        with open(log, "a") as f:
            f.write("x")
        raise RuntimeError("Error code: 402 - payment_required_error")

    got = w.run("r1", [Provider("first", out), Provider("keyless", out, has_key=False), Provider("second", offline_scorer)], wave=6)
    told = got.counters.first()
    assert (told.batches, told.failed_batches, told.provider, told.switched) == (12, 0, "second", 1) and got.delivered.count() == 60
    with open(log) as f:
        assert f.read() == "x"


def test_failover_cases():
    slept, ids = [], [{"id": "a", "score": 1}, {"id": "b", "score": 2}]

    def says(*answers):
        left = list(answers)

        def ask(batch):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return ask

    good = offline_scorer(ids)
    dead = [RuntimeError(x) for x in ("Error code: 402 - quota", "Error code: 401", "403 denied", "insufficient_quota")] + [PermanentError("gone")]
    for e in dead:  # the next provider answers; the dead one isn't asked again
        f = Failover([Provider("a", says(e)), Provider("b", says(good, good))], sleep=slept.append)
        assert f.ask(ids) == ("b", good) == f.ask(ids) and f.counters["switched"] == 1 and f.dead == {"a"}
    assert slept == []
    f = Failover([Provider("a", says(RuntimeError("429 rate_limit"), RuntimeError("503"), good))], sleep=slept.append)  # waits longer and longer
    assert f.ask(ids) == ("a", good) and slept == [20, 40] and not f.dead and f.counters["switched"] == 0
    f = Failover([Provider("a", says(RuntimeError("Read timed out"), good)), Provider("b", says(good))], sleep=slept.append)  # this batch only
    assert f.ask(ids) == ("b", good) and f.ask(ids) == ("a", good) and not f.dead and f.provider == "a"
    f = Failover([Provider("a", says("no array", "[1, ")), Provider("b", says(good))], sleep=slept.append)  # unreadable
    assert f.ask(ids) == ("b", good) and [k for _, k, _ in f.asked] == ["unreadable", "answer"]
    f = Failover([Provider("a", says(PermanentError()))], sleep=slept.append)  # none is left
    assert f.ask(ids) is None and f.ask(ids) is None and f.counters == {"batches": 2, "failed_batches": 2, "unscored": 4, "switched": 1}
    assert len(slept) == 2
    registry = {"a": Provider("a", good), "b": Provider("b", good, has_key=False), "c": Provider("c", good)}
    assert [p.name for p in funnel_ops.in_order(registry, "c, b,unknown,a")] == ["c", "a"]


def test_step_is_done_once(spark, tmp_path):
    steps, made = run_log.Steps(spark, f"file://{tmp_path}/log"), []

    def make():
        made.append(1)
        return spark.range(3)

    assert steps.once("a", make).count() == steps.once("a", make).count() == 3 and made == [1]
    assert steps.all("b") is None and steps.all("a").count() == 3


def test_offline_scorer_keeps_scores():
    assert json.loads(offline_scorer([{"id": "x", "score": 7}]))[0]["score"] == 7
