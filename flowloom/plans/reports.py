"""Counts, rates and evaluations of alerts and incidents, and their HTML and markdown forms."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import family, format_duration, format_time, is_low_confidence, layer, loss_percent, one_or_mixed, percent_of


def severity_by_day(incidents: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return incidents.groupBy(F.date_format(F.timestamp_micros("first_us"), "yyyy-MM-dd").alias("day")).agg(count("HIGH"), count("MEDIUM"), count("LOW"))


def type_counts(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("kind").agg(F.count("*").alias("incidents"), F.count_if(is_low_confidence()).alias("low_confidence"))


def top(rows: DataFrame, key: str, name: str, n: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key).limit(n)


def day_chart(incidents: DataFrame) -> DataFrame:
    """severity_by_day with each day's total, the largest total, and bar widths in percent of it."""
    x = severity_by_day(incidents).withColumn("total", F.col("high") + F.col("medium") + F.col("low"))
    x = x.withColumn("most", F.max("total").over(Window.partitionBy()))  # a row a day
    return x.select("*", *[percent_of(F.col(c), F.col("most")).alias(f"{c}_width") for c in ("high", "medium", "low")])


def top_sources(incidents: DataFrame, n: int) -> DataFrame:
    """Sources of most incidents; of equal ones that which appears first."""
    counts = incidents.groupBy("src").agg(F.count("*").alias("incidents"), F.min("first_us").alias("first_us"))
    return counts.orderBy(F.desc("incidents"), "first_us", "src").limit(n).select("src", "incidents")


def shown_and_hidden(rows: DataFrame, limit: int) -> DataFrame:
    """How many rows a list of `limit` lines shows, and how many it hides."""
    n = rows.agg(F.count("*").alias("n"))
    return n.select(F.least("n", F.lit(limit)).alias("shown"), F.greatest(F.col("n") - limit, F.lit(0)).alias("hidden"))


def shares(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows and share of each value of a key, and where it first occurs."""
    x = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row a value


def layers(alerts: DataFrame, keys: list[str]) -> DataFrame:
    """Where each group's alerts come from (one layer, or mixed) and how many were shown; alerts without `notified` were."""
    return alerts.groupBy(*keys).agg(one_or_mixed(F.collect_set(layer())).alias("layer"), F.count("*").alias("alerts"), F.count_if(F.coalesce("notified", F.lit(True))).alias("shown"))


def summarize(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("kind").agg(F.count("*").alias("logged"), F.count_if("notified").alias("notified"), F.countDistinct("src", "dst").alias("pairs"))


def soak_rates(alerts: DataFrame) -> DataFrame:
    """Alerts and notices an hour, by kind; the session lasts from the first alert to the last."""
    hours = alerts.agg(((F.max("t_us") - F.min("t_us")) / 3.6e9).alias("hours"))
    per = lambda n: F.round(F.when(F.col("hours") > 0, n / F.col("hours")), 6)
    kinds = alerts.groupBy("kind").agg(F.count("*").alias("alerts"), F.count_if("notified").alias("shown"))
    return kinds.crossJoin(F.broadcast(hours)).select("kind", "alerts", per(F.col("alerts")).alias("per_hour"), per(F.col("shown")).alias("notified_per_hour"))  # one row


def kinds_per_capture(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("capture", "kind").agg(F.count("*").alias("alerts"), F.count_if("notified").alias("shown"))


def wrong_kinds(alerts: DataFrame, expected: DataFrame) -> DataFrame:
    """Kinds that a capture raised though another was expected; generic scans pass where a scan is expected."""
    fine = (F.col("kind") == F.col("expected")) | (F.col("expected").isin(*K.SCAN_KINDS) & F.col("kind").isin(*K.GENERIC_RECON))
    return alerts.join(expected, "capture").where(~fine).groupBy("capture", "expected", "kind").agg(F.count("*").alias("alerts"))


def evaluate(alerts: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected capture: alerts, notices, whether anything and whether the right thing was found and shown."""
    right = F.col("kind") == F.col("expected")
    x = expected.join(alerts, "capture", "left").groupBy("capture", "expected")
    return x.agg(F.count("kind").alias("logged"), F.count_if("notified").alias("notified"), (F.count("kind") > 0).alias("detected"), F.coalesce(F.bool_or(right), F.lit(False)).alias("correct"), F.coalesce(F.bool_or(right & F.col("notified")), F.lit(False)).alias("correct_shown"))


def normal_captures(alerts: DataFrame, captures: DataFrame) -> DataFrame:
    """Per capture of normal traffic: alerts, notices and kinds, all of which are false."""
    x = captures.select("capture").join(alerts, "capture", "left").groupBy("capture")
    return x.agg(F.count("kind").alias("alerts"), F.count_if("notified").alias("notified"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def summary(evaluated: DataFrame, wrong: DataFrame, in_training: DataFrame) -> DataFrame:
    """Totals of evaluate()'s captures apart by whether the model has seen them (capture, in_training)."""
    bad = wrong.select("capture").distinct().withColumn("wrong", F.lit(True))
    x = evaluated.join(in_training, "capture").join(bad, "capture", "left").groupBy("in_training")
    return x.agg(
        F.count("*").alias("captures"), F.count_if("detected").alias("detected"), F.count("expected").alias("checkable"), F.count_if("correct").alias("correct"), F.count_if("correct_shown").alias("shown"),
        F.count_if(F.coalesce("wrong", F.lit(False))).alias("with_wrong"), F.sum("logged").alias("logged"), F.sum("notified").alias("notified"),
    )


def totals(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(F.count("*").alias("captures"), F.count_if("detected").alias("detected"), F.count_if("correct").alias("correct"), F.count_if("correct_shown").alias("shown"), F.sum("logged").alias("logged"), F.sum("notified").alias("notified"))


def gained(with_layer: DataFrame, without: DataFrame) -> DataFrame:
    """Kinds of which one run has more alerts than another, and how many more."""
    a, b = (x.groupBy("kind").agg(F.count("*").alias(n)) for x, n in ((with_layer, "a"), (without, "b")))
    more = (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("gained")
    return a.join(b, "kind", "full_outer").select("kind", more).where("gained > 0")


def time_split(rows: DataFrame, order: list[str], share: float) -> DataFrame:
    """rows with part: the first share of them in order is train, the rest holdout.

    The cut is a value of the order, found by ranking within time buckets and adding the buckets' counts, so no task ranks
    the whole table.
    """
    x = rows.withColumn("bucket", F.floor(F.col(order[0]) / (600 * K.SECOND_US)))
    sizes = x.groupBy("bucket").agg(F.count("*").alias("n"))
    by = Window.orderBy("bucket")  # a row for ten minutes
    sizes = sizes.select("bucket", (F.sum("n").over(by) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*order)) + F.col("before")
    return x.join(sizes, "bucket").withColumn("part", F.when(place <= F.floor(F.col("total") * share), "train").otherwise("holdout")).drop("bucket", "before", "total")


def relative_gap(rows: DataFrame, side: str, features: list[str], bound: float = 0.5) -> DataFrame:
    """Means of features on either side (a boolean column), their relative gap, and whether it passes the bound."""
    means = rows.groupBy(side).agg(*[F.avg(f).alias(f) for f in features])
    long = means.unpivot([side], features, "feature", "mean").groupBy("feature").pivot(side, [True, False]).agg(F.first("mean"))
    gap = F.abs(F.col("true") - F.col("false")) / F.greatest(F.abs("true"), F.abs("false"))
    return long.select("feature", F.col("true").alias("mean_a"), F.col("false").alias("mean_b"), gap.alias("gap"), (gap > bound).alias("marked"))


# ---------------------------------------------------------------- documents


def _table(title: str, df: DataFrame, limit: int) -> str:
    rows = df.limit(limit).collect()  # a report's lines
    cells = lambda r, tag: "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in r)
    return f"<h2>{html.escape(title)}</h2><table><tr>{cells(df.columns, 'th')}</tr>" + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in rows) + "</table>"


INCIDENTS_SHOWN, ALERTS_SHOWN, CAMPAIGNS_SHOWN, SOURCES_SHOWN, PAIRS_SHOWN = 100, 50, 100, 5, 10


def cards(alerts: DataFrame, incidents: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One row: campaigns and those of each severity, incidents and those to review, alerts and those shown."""
    of = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    a = alerts.agg(F.count("*").alias("alerts"), F.count_if(F.coalesce("notified", F.lit(True))).alias("shown"))
    i = incidents.agg(F.count("*").alias("incidents"), F.count_if(is_low_confidence()).alias("to_review"))
    return campaigns.agg(F.count("*").alias("campaigns"), of("HIGH"), of("MEDIUM"), of("LOW")).join(i).join(a)  # a row each


def marked_incidents(incidents: DataFrame, alerts: DataFrame) -> DataFrame:
    """incidents with layer (of the alerts of their source and kind: one, or mixed), review (low confidence) and unsure (an alert of them
    carries a model's unsure verdict); alerts may have notified, model_verdict and unsure."""
    a = alerts if "model_verdict" in alerts.columns else alerts.withColumn("model_verdict", F.when(F.col("kind") == "anomaly", "anomaly"))
    held = F.coalesce(F.bool_or("unsure"), F.lit(False)) if "unsure" in a.columns else F.lit(False)
    x = a.groupBy(F.col("src").alias("_src"), F.col("kind").alias("_kind")).agg(one_or_mixed(F.collect_set(layer())).alias("layer"), held.alias("unsure"))
    met = incidents.join(x, F.col("src").eqNullSafe(F.col("_src")) & F.col("kind").eqNullSafe(F.col("_kind")), "left").drop("_src", "_kind")
    return met.withColumn("unsure", F.coalesce("unsure", F.lit(False))).withColumn("review", F.coalesce(is_low_confidence(), F.lit(False)))


def bars(rows: DataFrame, value: str) -> DataFrame:
    """rows (a report's lines) with width, the value in percent of the largest."""
    return rows.withColumn("width", percent_of(F.col(value), F.max(value).over(Window.partitionBy())))


def _cards(row) -> str:
    shown = (("Campaigns", row.campaigns), ("HIGH campaigns", row.high), ("MEDIUM campaigns", row.medium), ("LOW campaigns", row.low), ("Incidents", row.incidents), ("Alerts logged (shown)", f"{row.alerts} ({row.shown})"), ("To review", row.to_review))
    return '<div class="cards">' + "".join(f'<div class="card"><div class="label">{a}</div><div class="value">{b}</div></div>' for a, b in shown) + "</div>"


def _bars(title: str, rows: list, name: str, widths: dict[str, str]) -> str:
    """widths: by class of the bar, the column of its width; the column without _width is its value."""
    if not rows:
        return f"<h2>{title}</h2><p class='empty'>No data.</p>"
    bar = lambda r, c, w: f'<div class="bar {c}" style="width:{r[w]}%">{r[w.removesuffix("_width")] if w != "width" else ""}</div>'
    return f"<h2>{title}</h2>" + "".join(f'<div class="row"><span class="name">{html.escape(str(r[name]))}</span>{"".join(bar(r, c, w) for c, w in widths.items())}</div>' for r in rows)


def _hidden(df: DataFrame, limit: int, what: str) -> str:
    n = shown_and_hidden(df, limit).first().hidden
    return f"<p class='small'>{n} more {what} not shown</p>" if n else ""


STYLE = (
    "body{font-family:sans-serif;margin:24px}table{border-collapse:collapse}td,th{padding:4px 8px;border-bottom:1px solid #ddd;text-align:left}.cards{display:flex;gap:12px;flex-wrap:wrap}"
    ".card{border:1px solid #ddd;padding:8px 16px}.value{font-size:28px}.row{display:flex;align-items:center}.name{width:160px}.bar{height:14px;background:#68c;margin-right:2px}.high{background:#c55}.medium{background:#ca5}.low{background:#7a7}"
)


def dashboard(alerts: DataFrame, incidents: DataFrame, campaigns: DataFrame, refresh_s: int = 0) -> str:
    """One HTML page: cards, campaigns, incidents with their layer and marks, bars by day, kind and source, and the newest alerts."""
    refresh = f'<meta http-equiv="refresh" content="{refresh_s}">' if refresh_s else ""
    seconds = lambda c: F.col(c) / K.SECOND_US
    when = lambda df: df.withColumns({"start": format_time(seconds("first_us")), "end": format_time(seconds("last_us")), "duration": format_duration(seconds("last_us") - seconds("first_us"))})
    marked = marked_incidents(incidents, alerts).withColumn("marks", F.concat_ws(" ", F.upper("layer"), F.when(F.col("unsure"), "model unsure"), F.when(F.col("review"), "review")))
    order = [F.when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1).desc(), F.desc("last_us")]
    listed = lambda c: F.array_join(c, ", ").alias(c)
    big = when(campaigns).orderBy(*order).select("severity", "pattern", "confidence", listed("sources"), listed("destinations"), listed("kinds"), "incidents", "alert_count", "start", "duration")
    small = when(marked).orderBy(*order).select("severity", "src", "kind", "marks", "confidence", "alert_count", "start", "end", "duration")
    newest = alerts.orderBy(F.desc("t_us")).select(format_time(seconds("t_us")).alias("time"), "kind", "src", "dst", "confidence")
    parts = [
        _cards(cards(alerts, incidents, campaigns).first()),
        _table("Campaigns", big, CAMPAIGNS_SHOWN), _hidden(campaigns, CAMPAIGNS_SHOWN, "campaigns"),
        _table("Incidents", small, INCIDENTS_SHOWN), _hidden(incidents, INCIDENTS_SHOWN, "incidents"),
        _bars("Days", day_chart(incidents).orderBy("day").limit(366).collect(), "day", {"high": "high_width", "medium": "medium_width", "low": "low_width"}),
        _bars("Kinds", bars(type_counts(incidents).orderBy(F.desc("incidents"), "kind").limit(50), "incidents").collect(), "kind", {"all": "width"}),
        _bars("Sources", bars(top_sources(incidents, SOURCES_SHOWN), "incidents").orderBy(F.desc("incidents")).collect(), "src", {"all": "width"}),
        _table("Alerts", newest, ALERTS_SHOWN), _hidden(alerts, ALERTS_SHOWN, "alerts"),
    ]
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'>{refresh}<title>Alerts</title><style>{STYLE}</style></head><body>{''.join(parts)}</body></html>"


def soak_pairs(alerts: DataFrame, limit: int = PAIRS_SHOWN) -> DataFrame:
    """The pairs of most alerts, ties by name."""
    return top(alerts.withColumn("pair", F.concat_ws(" -> ", F.coalesce("src", F.lit("?")), F.coalesce("dst", F.lit("?")))), "pair", "alerts", limit)


def per_hour(counts: DataFrame, hours: float | None, count: str) -> DataFrame:
    """counts with per_hour; null where the time isn't known."""
    return counts.withColumn("per_hour", F.round(F.col(count) / hours, 2) if hours and hours > 0 else F.lit(None).cast("double"))


def soak(alerts: DataFrame, session: DataFrame | None, notified_shown: int = 1000) -> str:
    """The report of a long run: alerts and notices an hour, by kind and family, busiest pairs and what was shown.

    session: one row with packets, windows, start_us, last_us and maybe end_us (null or absent: it didn't stop cleanly); None where
    the run left none, so that its time isn't known. A session without packets is an error: no alerts mean nothing then.
    """
    told = alerts.where(F.coalesce("notified", F.lit(True)))
    about, hours = ["No session: the time of the run isn't known."], None
    if session is not None:
        s = session.first()
        if s is None or not s.packets:
            raise ValueError("the session saw no packets, so its alerts mean nothing")
        end = s["end_us"] if "end_us" in session.columns else None
        span = (end if end is not None else s.last_us) - s.start_us if s.start_us is not None and (end is not None or s.last_us is not None) else None
        hours = span / (3600 * K.SECOND_US) if span and span > 0 else None
        about = [f"{s.packets} packets, {s.windows} windows, {'-' if hours is None else f'{hours:.2f}'} h, {'stopped cleanly' if end is not None else 'not stopped cleanly'}."]
    n = alerts.agg(F.count("*").alias("logged"), F.count_if(F.coalesce("notified", F.lit(True))).alias("notified"))
    both = per_hour(n.unpivot([], ["logged", "notified"], "alerts", "n"), hours, "n")
    order = lambda df, key: per_hour(df, hours, "alerts").orderBy(F.desc("alerts"), key)
    count = lambda df, key: df.groupBy(key).agg(F.count("*").alias("alerts"))
    shown = told.orderBy("t_us").select(format_time(F.col("t_us") / K.SECOND_US).alias("time"), "kind", "src", "dst")
    parts = [("Alerts", both), ("Logged by kind", order(count(alerts, "kind"), "kind")), ("Notified by family", order(count(told.withColumn("family", family("kind")), "family"), "family")), (f"Top {PAIRS_SHOWN} pairs", soak_pairs(alerts)), ("Shown", shown)]
    return "\n".join(["# Soak", "", *about, "", *[markdown(title, df, notified_shown) for title, df in parts]])


def markdown(title: str, df: DataFrame, limit: int = 1000) -> str:
    rows = df.limit(limit).collect()  # a report's lines
    line = lambda r: "| " + " | ".join("-" if v is None else str(v) for v in r) + " |"
    return "\n".join([f"## {title}", "", line(df.columns), "|" + "---|" * len(df.columns), *map(line, rows)]) + "\n"


def live_losses(results: DataFrame) -> DataFrame:
    """name, received, dropped and loss in percent of each measured capture path of live_results()."""
    x = results.select(F.explode("capture_path").alias("name", "x")).select("name", "x.*")
    return x.withColumn("loss_percent", loss_percent(F.col("received"), F.col("dropped")))


def live(results: DataFrame | None) -> str:
    """What was once measured live, as a section of a report; it isn't measured anew."""
    row = results.first() if results is not None else None
    if row is None:
        return "## Live\n\nNothing was measured live.\n"
    found = results.select(F.explode("detections").alias("name", "x")).select("name", F.when(F.col("x.detected"), "detected").otherwise("missed").alias("result"), "x.by", "x.half_open", "x.ports")
    about = f"## Live\n\nMeasured {row.measured_on} on {row.interface} with {row.generator}; not measured anew here.\n"
    return "\n".join([about, markdown("Loss", live_losses(results).orderBy("name")), markdown("Detections", found.orderBy("name")), row.note or ""])


def metrics(alerts: DataFrame, expected: DataFrame, normal: DataFrame) -> str:
    """The evaluation as a document; expected has capture, expected and in_training, normal has capture."""
    found, wrong = evaluate(alerts, expected.select("capture", "expected")), wrong_kinds(alerts, expected.select("capture", "expected"))
    parts = [("Summary", summary(found, wrong, expected.select("capture", "in_training"))), ("Attack captures", found.orderBy("capture")), ("Wrong kinds", wrong.orderBy("capture", "kind")), ("Normal captures", normal_captures(alerts, normal).orderBy("capture"))]
    return "\n".join(["# Metrics", "", *[markdown(title, df) for title, df in parts]])
