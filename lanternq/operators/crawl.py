"""The crawl queue as table transitions, a crawl that keeps queue and pages as tables, and a small crawl in memory.

A task is (url, host, state, attempts, last_error, finished_at, seq); states are pending, processing, done, failed.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urldefrag, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dom, urls
from ..sources import generation
from ..sources.staging import stage

#: Rows of one host that are numbered by one task.
SLICE = 50_000
STATE = F.col


def enqueue(tasks: DataFrame, urls: DataFrame) -> DataFrame:
    """The urls (url, host) that no task has, whatever its state, once each."""
    return urls.filter("url is not null").dropDuplicates(["url"]).join(tasks.select("url").distinct(), "url", "left_anti")


def recover(tasks: DataFrame) -> DataFrame:
    """Tasks in processing are pending again."""
    on = STATE("state") == "processing"
    return tasks.withColumns({"finished_at": F.when(on, None).otherwise(F.col("finished_at")), "state": F.when(on, "pending").otherwise(F.col("state"))})


def claim(tasks: DataFrame, n: int) -> DataFrame:
    """The n oldest pending tasks, now processing."""
    few = tasks.filter(STATE("state") == "pending").orderBy("seq").limit(n)
    return few.withColumns({"state": F.lit("processing"), "attempts": F.coalesce("attempts", F.lit(0)) + 1, "last_error": F.lit(None).cast("string")})


def complete(tasks: DataFrame, on: Column, now: str) -> DataFrame:
    return tasks.withColumns({"state": F.when(on, "done").otherwise(F.col("state")), "finished_at": F.when(on, now).otherwise(F.col("finished_at")), "last_error": F.when(on, None).otherwise(F.col("last_error"))})


def fail(tasks: DataFrame, on: Column, error: str, now: str, most: int = 3) -> DataFrame:
    """Failing tasks are pending again below `most` attempts, else failed."""
    again = F.col("attempts") < most
    return tasks.withColumns(
        {
            "state": F.when(on & again, "pending").when(on, "failed").otherwise(F.col("state")),
            "finished_at": F.when(on & again, None).when(on, now).otherwise(F.col("finished_at")),
            "last_error": F.when(on, error).otherwise(F.col("last_error")),
        }
    )


def requeue(tasks: DataFrame, cutoff: str, failed: bool = False) -> DataFrame:
    """Done tasks finished at the cutoff or before, or at an unknown time, are pending again; failed ones on demand."""
    on = (STATE("state") == "done") & (F.col("finished_at").isNull() | (F.col("finished_at") <= cutoff))
    if failed:
        on = on | (STATE("state") == "failed")
    return tasks.withColumns({"attempts": F.when(on, 0).otherwise(F.col("attempts")), "finished_at": F.when(on, None).otherwise(F.col("finished_at")), "state": F.when(on, "pending").otherwise(F.col("state"))})


def state_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(F.count(F.lit(1)).alias("tasks"))


def host_schedule(tasks: DataFrame, delay: float) -> DataFrame:
    """(seq, host, url, offset): pending tasks with the seconds that their host's delay makes them wait.

    A host is numbered by slices of seq, and slices are added up, so that a large host is not one task's work.
    """
    wait = tasks.filter((STATE("state") == "pending") & F.col("host").isNotNull()).withColumn("slice", F.floor(F.col("seq") / SLICE))
    sizes = wait.groupBy("host", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("host").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("host", "slice", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("host", "slice").orderBy("seq"))
    return wait.withColumn("n", own).join(sizes, ["host", "slice"]).select("seq", "host", "url", F.round((F.col("before") + F.col("n") - 1) * delay, 3).alias("offset"))


Fetcher = Callable[[str], tuple[str, str | None] | None]


def crawl(seeds: list[str], fetch: Fetcher, max_pages: int = 100, attempts: int = 3, allowed: set[str] | None = None, refresh_hours: float | None = None, retry_failed: bool = False, delay: float = 0.0, tasks: dict[str, dict] | None = None, save: Callable[[str, dict], None] = lambda _u, _p: None) -> tuple[dict[str, int], dict[str, dict]]:
    """Breadth-first crawl on the driver: counters and the tasks by url.

    fetch gives (final url, page), no page for what is no page, or None for an error; a url outside the allowed hosts, before or after redirects, is
    skipped. Errors go to the front of the queue until attempts are used up. Pages are saved under their final url.
    With refresh_hours, done tasks that ended so long ago (or at an unknown time) are fetched again; with retry_failed,
    failed ones too. A host is not asked again within `delay` seconds.
    """
    if attempts <= 0:
        raise ValueError("attempts must be positive")
    if refresh_hours is not None and (not math.isfinite(refresh_hours) or refresh_hours < 0):
        raise ValueError("refresh hours must be finite and not negative")
    stats = dict.fromkeys(("scheduled", "processed", "saved", "skipped", "retried", "failed", "refreshed", "requeued_failed"), 0)
    tasks = {} if tasks is None else tasks
    if max_pages <= 0:
        return stats, tasks
    inside = lambda u: urlsplit(u).scheme in ("http", "https") and (urlsplit(u).hostname or "") in hosts
    seeds = [urldefrag(u)[0] for u in seeds]
    hosts = allowed or {urlsplit(u).hostname or "" for u in seeds}
    old = None if refresh_hours is None else (datetime.now(UTC) - timedelta(hours=refresh_hours)).isoformat()
    for t in tasks.values():
        stale = old is not None and t["state"] == "done" and (t["finished_at"] is None or t["finished_at"] <= old)
        again = retry_failed and t["state"] == "failed"
        stats["refreshed"] += stale
        stats["requeued_failed"] += again
        if stale or again:
            t |= {"state": "pending", "attempts": 0, "finished_at": None}
        if t["state"] == "processing":
            t["state"] = "pending"
    free: dict[str, float] = {}
    queue: list[str] = [u for u, t in tasks.items() if t["state"] == "pending"]

    def schedule(url: str) -> None:
        if url not in tasks and inside(url):
            tasks[url] = {"state": "pending", "attempts": 0, "last_error": None, "finished_at": None}
            queue.append(url)

    for u in seeds:
        schedule(u)
    while queue and stats["scheduled"] < max_pages:
        url = queue.pop(0)
        task = tasks[url]
        task["state"], task["attempts"] = "processing", task["attempts"] + 1
        stats["scheduled"] += task["attempts"] == 1
        stats["processed"] += 1
        host = urlsplit(url).hostname or ""
        if delay > 0:
            time.sleep(max(0.0, free.get(host, 0.0) - time.monotonic()))
            free[host] = time.monotonic() + delay
        now = datetime.now(UTC).isoformat()
        got = fetch(url)
        if got is None:
            again = task["attempts"] < attempts
            task |= {"state": "pending" if again else "failed", "last_error": "fetch failed", "finished_at": None if again else now}
            stats["retried" if again else "failed"] += 1
            if again:
                queue.insert(0, url)
            continue
        final, page = got
        if page is None or not inside(final):
            stats["skipped"] += 1
        else:
            x = dom.extract(page, final)
            save(final, x)
            stats["saved"] += 1
            for link in x["links"]:
                schedule(link)
        task |= {"state": "done", "finished_at": now, "last_error": None}
    return stats, tasks


TASKS = "url string, host string, state string, attempts int, last_error string, finished_at string, seq long"
FETCHED = "url string, final string, outcome string, title string, text string, content_html string, links array<string>, error string"
#: Pages of one round: between two rounds queue and pages are written.
ROUND = 1000


def inside(url: str, hosts: frozenset[str]) -> bool:
    try:
        at = urlsplit(url)
    except ValueError:
        return False
    return at.scheme in ("http", "https") and (at.hostname or "") in hosts


def fetched(tasks: DataFrame, fetch: Fetcher, hosts: frozenset[str], delay: float, fetchers: int) -> DataFrame:
    """FETCHED rows of tasks (url, host, ..), by so many tasks at a time; a host is asked by one of them, at its pace.

    The outcome is saved, skipped (no page, or outside the hosts), or error (no answer, or a page that cannot be read).
    """

    def read(url: str) -> tuple:
        try:
            got = fetch(url)
            if got is None:
                return url, None, "error", None, None, None, [], "fetch failed"
            final, page = got
            if page is None or not inside(final, hosts):
                return url, final, "skipped", None, None, None, [], None
            x = dom.extract(page, final)
            return url, final, "saved", x["title"], x["text"], x["content_html"], [u for u in x["links"] if inside(u, hosts)], None
        except Exception as e:  # noqa: BLE001
            return url, None, "error", None, None, None, [], f"{type(e).__name__}: {e}"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free: dict[str, float] = {}
        for frame in frames:
            rows = []
            for url, host in zip(frame.url, frame.host, strict=True):
                if delay > 0:
                    time.sleep(max(0.0, free.get(host, 0.0) - time.monotonic()))
                    free[host] = time.monotonic() + delay
                rows.append(read(url))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FETCHED.split(", ")])

    return tasks.select("url", "host").repartition(fetchers, "host").mapInPandas(run, FETCHED)


def applied(tasks: DataFrame, got: DataFrame, attempts: int, now: str) -> DataFrame:
    """The tasks after a round: claimed and then done, pending again or failed, as their outcome says; links are new tasks."""
    told = got.select("url", "outcome", "error")
    on = F.col("outcome").isNotNull()
    after = tasks.join(told, "url", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)) + F.when(on, 1).otherwise(0))
    again = on & (F.col("outcome") == "error") & (F.col("attempts") < attempts)
    lost = on & (F.col("outcome") == "error") & ~again
    state = F.when(again, "pending").when(lost, "failed").when(on, "done").otherwise(F.col("state"))
    after = after.withColumns({"state": state, "finished_at": F.when(again, None).when(on, now).otherwise(F.col("finished_at")), "last_error": F.when(on, F.col("error")).otherwise(F.col("last_error"))})
    links = got.select(F.explode("links").alias("url")).select("url", urls.host(F.col("url")).alias("host"))
    return with_new(after.select(*[c.split(" ")[0] for c in TASKS.split(", ")]), links)


def with_new(tasks: DataFrame, found: DataFrame) -> DataFrame:
    """The tasks and a pending one for each url that none of them has, numbered after them.

    New ones are numbered by hash slices, whose sizes are added up, so that no task sorts all of them.
    """
    last = tasks.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    new = enqueue(tasks, found).withColumn("slice", F.pmod(F.xxhash64("url"), F.lit(1024)))
    sizes = new.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 1024 rows
    sizes = sizes.select("slice", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("slice").orderBy("url"))
    new = new.withColumn("n", own).join(F.broadcast(sizes), "slice").crossJoin(F.broadcast(last))  # 1024 rows, one row
    none = F.lit(None).cast("string")
    return tasks.unionByName(new.select("url", "host", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), none.alias("last_error"), none.alias("finished_at"), (F.col("last") + F.col("before") + F.col("n")).alias("seq")))


def saved_pages(spark: SparkSession, directory: str, got: DataFrame, now: str) -> None:
    """Add the pages of a round to the stored documents: a url that is known keeps its id, others get the next ones."""
    try:
        manifest, old = generation.load(spark, directory)
        known = old["documents"].select(F.col("url").alias("final"), F.col("document_id").alias("old_id"))
    except ValueError:
        manifest, old, known = None, {}, spark.createDataFrame([], "final string, old_id long")
    rows = got.filter("outcome = 'saved'").dropDuplicates(["final"]).join(known, "final", "left")
    last = known.agg(F.coalesce(F.max("old_id"), F.lit(0)).alias("last"))
    number = F.row_number().over(Window.partitionBy(F.col("old_id").isNull()).orderBy("final"))  # the rows of one round
    rows = rows.crossJoin(F.broadcast(last)).withColumn("document_id", F.coalesce("old_id", F.col("last") + number))
    rows = stage(rows.select("document_id", F.col("final").alias("url"), "title", "text", F.lit(now).alias("fetched_at"), "content_html"), "pages")
    if manifest is not None and len(manifest["segments"]) >= generation.MOST_SEGMENTS:
        rows, manifest = old["documents"].join(rows.select("document_id"), "document_id", "left_anti").unionByName(rows), None
    generation.publish(directory, {"documents": rows, "ids": rows.select("document_id")}, manifest)


def crawl_into(spark: SparkSession, directory: str, seeds: list[str], fetch: Fetcher, max_pages: int = 100, attempts: int = 3, allowed: set[str] | None = None, refresh_hours: float | None = None, retry_failed: bool = False, delay: float = 0.0, fetchers: int = 8, round_size: int = ROUND) -> tuple[dict[str, int], DataFrame | None]:
    """Crawl with the queue and the pages kept in a folder on any file system; counters, and the documents so far.

    Every round claims the oldest pending tasks, fetches them in parallel, writes their pages, and then the queue; a crawl
    that is stopped goes on from the last round. At most max_pages new tasks are taken, others stay pending. For the
    options see `crawl`. The documents are (document_id, url, title, text, fetched_at, content_html), None if there are none.
    """
    if attempts <= 0 or fetchers <= 0 or round_size <= 0:
        raise ValueError("attempts, fetchers and round size must be positive")
    if refresh_hours is not None and (not math.isfinite(refresh_hours) or refresh_hours < 0):
        raise ValueError("refresh hours must be finite and not negative")
    stats = dict.fromkeys(("scheduled", "processed", "saved", "skipped", "retried", "failed", "refreshed", "requeued_failed"), 0)
    queue, pages = f"{directory}/queue", f"{directory}/pages"
    try:
        tasks = generation.load(spark, queue)[1]["tasks"]
    except ValueError:
        tasks = spark.createDataFrame([], TASKS)
    if max_pages > 0:
        seeds = [urldefrag(u)[0] for u in seeds]
        hosts = frozenset(allowed or {urlsplit(u).hostname or "" for u in seeds})
        old = None if refresh_hours is None else (datetime.now(UTC) - timedelta(hours=refresh_hours)).isoformat()
        stale = (F.col("state") == "done") & (F.col("finished_at").isNull() | (F.col("finished_at") <= old)) if old else F.lit(False)
        broken = (F.col("state") == "failed") & F.lit(retry_failed)
        r = tasks.agg(F.count_if(stale).alias("refreshed"), F.count_if(broken).alias("requeued_failed")).first()
        stats |= r.asDict()
        again = stale | broken
        tasks = tasks.withColumns({"attempts": F.when(again, 0).otherwise(F.col("attempts")), "finished_at": F.when(again, None).otherwise(F.col("finished_at")), "state": F.when(again, "pending").otherwise(F.col("state"))})
        first = spark.createDataFrame([(u, urlsplit(u).hostname) for u in seeds if inside(u, hosts)], "url string, host string")
        tasks = stage(with_new(recover(tasks), first), "queue")
        while True:
            pending = tasks.filter("state = 'pending'")
            tried = pending.filter("attempts > 0").orderBy("seq").limit(round_size)
            fresh = pending.filter("coalesce(attempts, 0) = 0").orderBy("seq").limit(min(round_size, max_pages - stats["scheduled"]))
            batch = stage(tried.unionByName(fresh), "round")
            taken = batch.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("attempts", F.lit(0)) == 0).alias("fresh")).first()
            if not taken.n:
                break
            now = datetime.now(UTC).isoformat()
            got = stage(fetched(batch, fetch, hosts, delay, fetchers), "fetched")
            saved_pages(spark, pages, got, now)
            counts = {x.outcome: x["count"] for x in got.groupBy("outcome").count().collect()}
            tasks = stage(applied(tasks, got, attempts, now), "queue")
            failed = tasks.join(got.filter("outcome = 'error'").select("url"), "url", "left_semi").filter("state = 'failed'").count()
            stats["scheduled"] += taken.fresh
            stats["processed"] += taken.n
            stats["saved"] += counts.get("saved", 0)
            stats["skipped"] += counts.get("skipped", 0)
            stats["failed"] += failed
            stats["retried"] += counts.get("error", 0) - failed
            generation.publish(queue, {"tasks": tasks})
        generation.publish(queue, {"tasks": tasks})
    try:
        return stats, generation.load(spark, pages)[1]["documents"]
    except ValueError:
        return stats, None
