"""Threshold, interval, percentile and log queries on labels, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave import rules
from corpusweave.functions import text as T
from corpusweave.functions.binding import bind
from corpusweave.operators import logs as Lg, metrics as M, reuse as Re
from corpusweave.operators.ordering import micros, percentiles, value_ranks
from corpusweave.plans import sqlkit as S
from corpusweave.plans.registry import query
from corpusweave.session import materialise

SCORES = f"""WITH tk AS (SELECT doc_id, lang, source, n_chars, {S.tokenize('text')} AS tk FROM documents),
sc AS (SELECT t.doc_id, lang, source, n_chars, CASE WHEN len(tk) = 0 THEN 0.0 ELSE round(len(list_distinct(tk)) / len(tk)::DOUBLE, 6) END AS score, quality, toxic FROM tk t JOIN labels l ON l.doc_id = t.doc_id)"""


def labelled_scores(t):
    """Share of distinct tokens as the score of every labelled document."""
    tokens = bind(t.documents.select("doc_id", "lang", "source", "n_chars", "text"), tk=T.tokenize(F.col("text")))
    score = F.when(F.size("tk") == 0, 0.0).otherwise(F.round(F.size(F.array_distinct("tk")) / F.size("tk"), 6))
    return tokens.select("doc_id", "lang", "source", "n_chars", score.alias("score")).join(t.labels, "doc_id")


@query(
    "auroc",
    f"""{SCORES} SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives,
    round((SELECT sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) FROM sc a, sc b WHERE a.quality = 1 AND b.quality = 0)
    / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auroc FROM sc""",
)
def auroc(t):
    return M.auroc(M.class_ranks(labelled_scores(t), "score", F.col("quality") == 1))


@query(
    "auroc_by_lang",
    f"""{SCORES}, p AS (SELECT a.lang, sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auroc FROM sc a JOIN sc b ON a.lang = b.lang WHERE a.quality = 1 AND b.quality = 0 GROUP BY a.lang)
    SELECT lang, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, round(any_value(auroc), 6) AS auroc FROM sc LEFT JOIN p USING (lang) GROUP BY lang""",
)
def auroc_by_lang(t):
    return M.auroc(M.class_ranks(labelled_scores(t), "score", F.col("quality") == 1, ["lang"]), ["lang"])


SWEEP = f"""{SCORES}, d AS (SELECT DISTINCT score FROM sc), c AS (SELECT (score + lead(score) OVER (ORDER BY score)) / 2 AS t FROM d),
th AS (SELECT t, count(*) FILTER (quality = 1 AND score < t) AS refused, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0 AND score >= t) AS accepted, count(*) FILTER (quality = 0) AS negatives
FROM c, sc WHERE t IS NOT NULL GROUP BY t), tr AS (SELECT *, round(refused / positives::DOUBLE, 4) AS refusal_rate, round(accepted / negatives::DOUBLE, 4) AS acceptance_rate FROM th)"""


@query("threshold_sweep", f"{SWEEP} SELECT round(t, 9) AS t, refused, positives, accepted, negatives, refusal_rate, acceptance_rate FROM tr")
def threshold_sweep(t):
    ranks = M.class_ranks(labelled_scores(t), "score", F.col("quality") == 1)
    return M.thresholds(ranks).withColumn("t", F.round("t", 9))


@query(
    "threshold_choice",
    f"""{SWEEP} SELECT round(t, 9) AS t, refusal_rate, acceptance_rate, refused, accepted FROM tr WHERE refusal_rate <= {rules.OOD_RULE['dev_max_refused']} ORDER BY acceptance_rate, tr.t LIMIT 1""",
)
def threshold_choice(t):
    ranks = M.class_ranks(labelled_scores(t), "score", F.col("quality") == 1)
    return M.best_threshold(M.thresholds(ranks), rules.OOD_RULE["dev_max_refused"])


@query(
    "score_overlap",
    f"""{SCORES}, e AS (SELECT min(score) FILTER (quality = 1) AS a, max(score) FILTER (quality = 1) AS b, min(score) FILTER (quality = 0) AS c, max(score) FILTER (quality = 0) AS d FROM sc)
    SELECT d < a AS clean_gap, greatest(a, c) AS overlap_low, least(b, d) AS overlap_high, count(*) FILTER (quality = 1 AND score <= d) AS in_at_or_below_max_out, count(*) FILTER (quality = 0 AND score >= a) AS out_at_or_above_min_in,
    count(*) FILTER (quality = 1) AS in_n, count(*) FILTER (quality = 0) AS out_n FROM sc, e GROUP BY a, b, c, d""",
)
def score_overlap(t):
    return M.score_overlap(materialise(labelled_scores(t)), "score", F.col("quality") == 1)


SPLIT = f"""{SCORES}, sp AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM sc)"""


def split_scores(t):
    """Even positions of each label's id order go to DEV, odd ones to TEST.

    The position is a running count over id ranges, so no task orders a whole label.
    """
    scores = materialise(labelled_scores(t))
    ranks = value_ranks(scores, "doc_id", {"n": F.lit(1)}, ["quality"])
    parity = ranks.select("quality", F.col("value").alias("doc_id"), F.when(F.col("n_before") % 2 == 0, "dev").otherwise("test").alias("split"))
    return scores.join(parity, ["quality", "doc_id"])


@query("dev_test_split", f"{SPLIT} SELECT doc_id, quality, split FROM sp")
def dev_test_split(t):
    return split_scores(t).select("doc_id", "quality", "split")


@query(
    "ood_decision",
    f"""{SPLIT}, au AS (SELECT sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS a FROM sp a, sp b WHERE a.quality = 1 AND b.quality = 0),
    dd AS (SELECT DISTINCT score FROM sp WHERE split = 'dev'), c AS (SELECT (score + lead(score) OVER (ORDER BY score)) / 2 AS t FROM dd),
    th AS (SELECT t, round(count(*) FILTER (quality = 1 AND score < t) / (count(*) FILTER (quality = 1))::DOUBLE, 4) AS rr, round(count(*) FILTER (quality = 0 AND score >= t) / (count(*) FILTER (quality = 0))::DOUBLE, 4) AS ar
        FROM c, sp WHERE t IS NOT NULL AND split = 'dev' GROUP BY t), st AS (SELECT t FROM th WHERE rr <= {rules.OOD_RULE['dev_max_refused']} ORDER BY ar, t LIMIT 1)
    SELECT count(*) FILTER (quality = 1) >= {rules.OOD_RULE['min_in_domain']} AND count(*) FILTER (quality = 0) >= {rules.OOD_RULE['min_ood']} AND least(count(*) FILTER (quality = 0 AND split = 'dev'), count(*) FILTER (quality = 0 AND split = 'test')) >= {rules.OOD_RULE['min_ood_per_split']} AS sample_ok,
    round(any_value(au.a), 6) AS auroc, any_value(au.a) >= {rules.OOD_RULE['auroc_min']} AS separation_ok, round(any_value(st.t), 9) AS t_star,
    round(count(*) FILTER (split = 'test' AND quality = 1 AND score < st.t) / (count(*) FILTER (split = 'test' AND quality = 1))::DOUBLE, 4) AS test_refusal_rate,
    round(count(*) FILTER (split = 'test' AND quality = 0 AND score >= st.t) / (count(*) FILTER (split = 'test' AND quality = 0))::DOUBLE, 4) AS test_acceptance_rate FROM sp, au, st""",
)
def ood_decision(t):
    """Sample sizes, separation and the held-out rates of the threshold chosen on DEV."""
    rows = materialise(split_scores(t))
    in_domain = F.col("quality") == 1
    area = M.auroc(M.class_ranks(rows, "score", in_domain)).select("auroc")
    # The DEV threshold, exact (not rounded), is one row; so is the area under the curve.
    dev = M.thresholds(M.class_ranks(rows.filter("split = 'dev'"), "score", in_domain))
    star = dev.filter(F.col("refusal_rate") <= rules.OOD_RULE["dev_max_refused"]).agg(F.min(F.struct("acceptance_rate", "t")).alias("b")).select(F.col("b.t").alias("t"))
    joined = rows.crossJoin(F.broadcast(area)).crossJoin(F.broadcast(star))

    def n(condition):
        return F.count_if(condition)

    dev_out, test_out = ~in_domain & (F.col("split") == "dev"), ~in_domain & (F.col("split") == "test")
    test_in, rule = in_domain & (F.col("split") == "test"), rules.OOD_RULE
    return joined.agg(
        ((n(in_domain) >= rule["min_in_domain"]) & (n(~in_domain) >= rule["min_ood"]) & (F.least(n(dev_out), n(test_out)) >= rule["min_ood_per_split"])).alias("sample_ok"),
        F.max("auroc").alias("auroc"), (F.max("auroc") >= rule["auroc_min"]).alias("separation_ok"), F.round(F.max("t"), 9).alias("t_star"),
        F.round(n(test_in & (F.col("score") < F.col("t"))) / n(test_in), 4).alias("test_refusal_rate"),
        F.round(n(test_out & (F.col("score") >= F.col("t"))) / n(test_out), 4).alias("test_acceptance_rate"),
    )


WILSON_SQL = "(k / n::DOUBLE + {z}::DOUBLE * {z}::DOUBLE / (2 * n) {s} {z}::DOUBLE * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + {z}::DOUBLE * {z}::DOUBLE / (4.0::DOUBLE * n * n))) / (1 + {z}::DOUBLE * {z}::DOUBLE / n)"


@query(
    "wilson_intervals",
    f"""WITH g AS (SELECT d.lang, sum(quality)::BIGINT AS k, count(*) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang)
    SELECT lang, k, n, round(greatest(0.0, {WILSON_SQL.format(z=rules.WILSON_Z, s='-')}), 4) AS low, round(least(1.0, {WILSON_SQL.format(z=rules.WILSON_Z, s='+')}), 4) AS high,
    round(greatest(0.0, {WILSON_SQL.format(z=rules.WILSON_Z_SHORT, s='-')}), 3) AS low_short, round(least(1.0, {WILSON_SQL.format(z=rules.WILSON_Z_SHORT, s='+')}), 3) AS high_short FROM g""",
)
def wilson_intervals(t):
    g = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    low_s, high_s = M.wilson(F.col("k"), F.col("n"), rules.WILSON_Z_SHORT, 3)
    return g.select("lang", "k", "n", low.alias("low"), high.alias("high"), low_s.alias("low_short"), high_s.alias("high_short"))


@query(
    "describe_scores",
    f"""{SCORES} SELECT lang, count(*) AS n, min(score) AS min, max(score) AS max, round(avg(score), 8) AS mean, round(stddev_samp(score), 8) AS stdev,
    {', '.join(f'round(quantile_cont(score, {p / 100}), 8) AS p{p}' for p in rules.PERCENTILES)} FROM sc GROUP BY lang""",
)
def describe_scores(t):
    return M.describe(labelled_scores(t), "score", ["lang"], digits=8)


@query(
    "percentile_variants",
    """WITH o AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events GROUP BY event_type)
    SELECT event_type, n, round(quantile_cont, 6) AS p95_linear, v[greatest(1, least(n, ceil(0.95 * n)))::BIGINT] AS p95_nearest, v[greatest(0, floor(n * 0.95) - 1)::BIGINT + 1] AS p95_floor_prev,
    v[least(floor(n * 0.5), n - 1)::BIGINT + 1] AS p50_floor FROM o JOIN (SELECT event_type, quantile_cont(value, 0.95) AS quantile_cont FROM events GROUP BY event_type) USING (event_type)""",
)
def percentile_variants(t):
    """The four percentile definitions in use, side by side."""
    ranks = value_ranks(t.events.select("event_type", "value"), "value", {"n": F.lit(1)}, ["event_type"])
    wanted = {
        "p95_linear": ("linear", 0.95), "p95_nearest": ("nearest", 0.95), "p95_floor_prev": ("floor_prev", 0.95), "p50_floor": ("floor", 0.5),
    }
    return percentiles(ranks, wanted, ["event_type"]).withColumn("p95_linear", F.round("p95_linear", 6))


@query(
    "outcome_pivot",
    """WITH o AS (SELECT d.lang, CASE WHEN l.quality = 1 THEN CASE WHEN l.toxic = 0 THEN 'answerable_answered_correct' ELSE 'answerable_abstained' END WHEN l.toxic = 1 THEN 'unsupported_correctly_abstained' ELSE 'unsupported_incorrectly_answered' END AS outcome,
    d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
    SELECT lang, count(*) AS n, count(*) FILTER (outcome = 'answerable_answered_correct') AS answered_correct, count(*) FILTER (outcome = 'answerable_abstained') AS wrongly_abstained,
    count(*) FILTER (outcome = 'unsupported_correctly_abstained') AS correctly_abstained, count(*) FILTER (outcome = 'unsupported_incorrectly_answered') AS wrongly_answered FROM o GROUP BY ROLLUP (lang)""",
)
def outcome_pivot(t):
    """Outcome label per case, then a category by outcome table with its total row."""
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    outcome = (
        F.when(quality & ~toxic, "answered_correct").when(quality, "wrongly_abstained").when(toxic, "correctly_abstained").otherwise("wrongly_answered")
    )
    cases = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("outcome", outcome)
    labels = ("answered_correct", "wrongly_abstained", "correctly_abstained", "wrongly_answered")
    return cases.rollup("lang").agg(F.count("*").alias("n"), *[F.count_if(F.col("outcome") == x).alias(x) for x in labels])


@query(
    "label_precision",
    f"""{SCORES}, p AS (SELECT lang, (score >= 0.7)::INT AS pred, quality FROM sc) SELECT lang, sum(pred)::BIGINT AS predicted, sum(quality)::BIGINT AS actual, sum(pred * quality)::BIGINT AS hits,
    CASE WHEN sum(pred) = 0 THEN 1.0 ELSE round(sum(pred * quality) / sum(pred)::DOUBLE, 6) END AS precision, CASE WHEN sum(quality) = 0 THEN 1.0 ELSE round(sum(pred * quality) / sum(quality)::DOUBLE, 6) END AS recall,
    round(sum(pred * quality) / nullif(sum(greatest(pred, quality)), 0)::DOUBLE, 6) AS jaccard FROM p GROUP BY lang""",
)
def label_precision(t):
    p = labelled_scores(t).select("lang", (F.col("score") >= 0.7).cast("int").alias("pred"), "quality")
    both = F.sum(F.col("pred") * F.col("quality"))
    return p.groupBy("lang").agg(
        F.sum("pred").alias("predicted"), F.sum("quality").alias("actual"), both.alias("hits"),
        F.when(F.sum("pred") == 0, 1.0).otherwise(F.round(both / F.sum("pred"), 6)).alias("precision"),
        F.when(F.sum("quality") == 0, 1.0).otherwise(F.round(both / F.sum("quality"), 6)).alias("recall"),
        F.round(both / F.nullif(F.sum(F.greatest("pred", "quality")), F.lit(0)), 6).alias("jaccard"),
    )


@query(
    "distinct_sources_per_result",
    """WITH r AS (SELECT conv_id, count(*) AS retrieved, count(DISTINCT md5(text)) AS distinct_documents FROM conversations GROUP BY conv_id) SELECT retrieved > distinct_documents AS repeated, count(*) AS results, sum(retrieved - distinct_documents)::BIGINT AS repeats FROM r GROUP BY 1""",
)
def distinct_sources_per_result(t):
    r = t.conversations.groupBy("conv_id").agg(F.count("*").alias("retrieved"), F.countDistinct(F.md5("text")).alias("d"))
    return r.groupBy((F.col("retrieved") > F.col("d")).alias("repeated")).agg(F.count("*").alias("results"), F.sum(F.col("retrieved") - F.col("d")).alias("repeats"))


@query(
    "mention_rates",
    """SELECT lang, count(*) AS n, round(avg(regexp_matches(lower(text), '(^|[^a-z0-9_])the($|[^a-z0-9_])')::INT), 6) AS mention_rate FROM documents GROUP BY lang""",
)
def mention_rates(t):
    flag = F.lower("text").rlike(r"(^|[^a-z0-9_])the($|[^a-z0-9_])")
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(flag.cast("int")), 6).alias("mention_rate"))


@query(
    "token_length_study",
    f"""WITH s AS (SELECT role, {S.token_estimate('text')} AS tokens FROM conversations) SELECT role, count(*) AS units, max(tokens) AS longest, round(quantile_cont(tokens, 0.95), 4) AS p95, count(*) FILTER (tokens > {rules.MODEL_MAX_TOKENS}) AS over_limit FROM s GROUP BY role""",
)
def token_length_study(t):
    sized = materialise(t.conversations.select("role", T.token_estimate(F.col("text")).alias("tokens")))
    p95 = percentiles(value_ranks(sized, "tokens", {"n": F.lit(1)}, ["role"]), {"p95": ("linear", 0.95)}, ["role"])
    totals = sized.groupBy("role").agg(F.count("*").alias("units"), F.max("tokens").alias("longest"), F.count_if(F.col("tokens") > rules.MODEL_MAX_TOKENS).alias("over_limit"))
    return totals.join(p95.select("role", F.round("p95", 4).alias("p95")), "role")


# ---------------------------------------------------------------- logs
def request_log(t):
    """Events as request records: errors, sign-ups that abstain, the rest answered."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "out_of_scope").otherwise("answered")
    return t.events.select(
        F.col("event_type").alias("route"), status.alias("status"), F.lit(200).alias("http_status"), F.lit("").alias("error"), F.col("value").alias("latency_ms")
    )


LOG = """r AS (SELECT event_type AS route, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'out_of_scope' ELSE 'answered' END AS status, value AS latency_ms FROM events)"""
LOG_COLS = """count(*) AS requests, count(*) FILTER (status = 'error') AS errors, coalesce(round(count(*) FILTER (status = 'out_of_scope') / nullif(count(*) FILTER (status IN ('out_of_scope', 'answered')), 0)::DOUBLE, 4), 0.0) AS abstention_rate,
round(quantile_cont(latency_ms, 0.5), 2) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 2) AS p95_latency_ms"""


@query("log_summary", f"WITH {LOG} SELECT {LOG_COLS} FROM r")
def log_summary(t):
    return Lg.log_summary(request_log(t))


@query("log_summary_by_route", f"WITH {LOG} SELECT route, {LOG_COLS} FROM r GROUP BY route")
def log_summary_by_route(t):
    return Lg.log_summary(request_log(t), ["route"])


@query("event_counts", "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def event_counts(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


@query(
    "json_lines",
    """SELECT event_type, count(*) AS records, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events WHERE json_valid(props) GROUP BY event_type""",
)
def json_lines(t):
    """Event payloads parsed as JSON lines, malformed ones skipped."""
    parsed = Lg.parse_json_lines(t.events.select("event_type", "props"), "props", "k bigint")
    return parsed.groupBy("event_type").agg(F.count("*").alias("records"), F.sum("record.k").alias("k_sum"))


RATE_SECONDS, RATE_MAX = 3600, 2


@query(
    "rate_window",
    """SELECT user_id, us, max(offered) AS offered, count(*) AS n FROM (SELECT user_id, epoch_us(ts) AS us, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS offered FROM events) GROUP BY ALL""",
)
def rate_window(t):
    return Lg.offered_in_window(t.events, "user_id", "ts").select("user_id", "us", "offered", "n")


@query(
    "rate_limit_decisions",
    f"""WITH RECURSIVE e0 AS (SELECT user_id, epoch_us(ts) AS us, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM e0),
    w AS (SELECT user_id, us, n, i, least(n, {RATE_MAX}) AS accepted, list_resize([]::BIGINT[], least(n, {RATE_MAX}), us) AS recent FROM e WHERE i = 1 UNION ALL
    SELECT e.user_id, e.us, e.n, e.i, least(e.n, greatest(0, {RATE_MAX} - len(list_filter(w.recent, lambda x: x > e.us - {RATE_SECONDS}000000)))) AS accepted,
        list_concat(list_filter(w.recent, lambda x: x > e.us - {RATE_SECONDS}000000), list_resize([]::BIGINT[], least(e.n, greatest(0, {RATE_MAX} - len(list_filter(w.recent, lambda x: x > e.us - {RATE_SECONDS}000000)))), e.us))
        FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
    SELECT user_id, us, n AS requests, accepted, n - accepted AS rejected FROM w""",
)
def rate_limit_decisions(t):
    """At most two accepted requests per user and hour; rejected ones do not count."""
    return Lg.rate_limit(t.events, "user_id", "ts", RATE_MAX, RATE_SECONDS)


SESS = """WITH o AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS p FROM events),
s AS (SELECT user_id, us, sum((p IS NULL OR us - p > 3600000000)::INT) OVER (PARTITION BY user_id ORDER BY us) AS session FROM o)"""


@query("sessions", f"{SESS} SELECT user_id, session::BIGINT AS session, count(*) AS events, min(us) AS start_us, max(us) AS end_us FROM s GROUP BY ALL")
def sessions(t):
    return Lg.sessions(t.events, "user_id", "ts")


CAPACITY, IDLE_SECONDS = 60, 12 * 3600


@query(
    "conversation_evictions",
    f"""WITH t AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events), p AS (SELECT *, row_number() OVER (ORDER BY us, user_id) AS pos FROM t),
    o AS (SELECT *, lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS prev, us - lag(us) OVER (PARTITION BY user_id ORDER BY pos) AS idle_us FROM p),
    d AS (SELECT o.user_id, o.us, o.idle_us, CASE WHEN o.prev IS NOT NULL THEN count(DISTINCT x.user_id) END AS distance
        FROM o LEFT JOIN o x ON x.pos > o.prev AND x.pos < o.pos GROUP BY o.user_id, o.us, o.idle_us, o.prev)
    SELECT *, CASE WHEN idle_us IS NULL THEN 'new' WHEN idle_us > {IDLE_SECONDS}000000 THEN 'expired' WHEN distance >= {CAPACITY} THEN 'evicted' ELSE 'kept' END AS outcome FROM d""",
)
def conversation_evictions(t):
    """Which touches still find their conversation in a store of 60 that forgets what was idle for half a day."""
    return Re.evictions(t.events, "user_id", "ts", CAPACITY, IDLE_SECONDS)


@query(
    "max_overlap",
    """WITH sp AS (SELECT event_type, epoch_us(ts) AS s, epoch_us(ts) + round(value * 60000000)::BIGINT AS e FROM events), g AS (SELECT event_type, s AS tm, 1 AS d FROM sp UNION ALL SELECT event_type, e, -1 FROM sp),
    n AS (SELECT event_type, tm, sum(d) AS d FROM g GROUP BY ALL), l AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY tm) AS o FROM n) SELECT event_type, max(o)::BIGINT AS max_open, count(*) AS instants FROM l GROUP BY event_type""",
)
def max_overlap(t):
    spans = t.events.select("event_type", micros("ts").alias("s"), (micros("ts") + F.round(F.col("value") * 60000000).cast("long")).alias("e"))
    return Lg.max_overlap(spans, ["event_type"], "s", "e", 86_400_000_000)


@query(
    "breaker_runs",
    """WITH o AS (SELECT user_id, event_id, (event_type IN ('error', 'signup'))::INT AS f FROM events), r AS (SELECT user_id, f, sum(1 - f) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM o),
    l AS (SELECT user_id, run, count(*) AS n FROM r WHERE f = 1 GROUP BY ALL) SELECT user_id, max(n) AS longest_run, max(n) >= 4 AS opens FROM l GROUP BY user_id""",
)
def breaker_runs(t):
    failed = F.col("event_type").isin("error", "signup")
    return Lg.breaker_runs(t.events, "user_id", F.col("event_id"), failed, 4, 10_000)


@query(
    "stage_latency",
    """SELECT o_orderpriority AS stage, count(*) AS n, median(o_totalprice)::DOUBLE AS median, list_sort(list(o_totalprice))[greatest(0, floor(count(*) * 0.95) - 1)::BIGINT + 1] AS p95 FROM orders GROUP BY 1""",
)
def stage_latency(t):
    """Median and the truncating 95th percentile per stage (order values stand in for timings)."""
    rows = t.orders.select(F.col("o_orderpriority").alias("stage"), "o_totalprice")
    ranks = value_ranks(rows, "o_totalprice", {"n": F.lit(1)}, ["stage"])
    return percentiles(ranks, {"median": ("linear", 0.5), "p95": ("floor_prev", 0.95)}, ["stage"])
