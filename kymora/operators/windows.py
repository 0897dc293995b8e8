"""Ordered operators over a stream that window functions can say; none needs more than its subject's partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymora.keys import SECOND, Stream


def last_known(x: Column, w) -> Column:
    return F.last(x, ignorenulls=True).over(w)


def wrap_degrees(d: Column) -> Column:
    """An angle difference in [-180, 180)."""
    return F.pmod(d + 180.0, F.lit(360.0)) - 180.0


def derivative(df: DataFrame, s: Stream, x: str, out: str, longest: float, shortest: float = 1e-6) -> DataFrame:
    """(x - previous) / dt; 0 at the first row and after a gap over ``longest`` seconds, held where dt <= ``shortest``."""
    df = df.withColumns({"__dt": s.seconds(), "__prev": F.lag(x).over(s.plain())})
    raw = F.when(F.col("__dt").isNull() | (F.col("__dt") > longest), 0.0).when(F.col("__dt") > shortest, (F.col(x) - F.col("__prev")) / F.col("__dt"))
    return df.withColumn("__raw", raw).withColumn(out, last_known(F.col("__raw"), s.rows())).drop("__dt", "__prev", "__raw")


def angular_speed(df: DataFrame, s: Stream, yaw: str, pitch: str, out: str) -> DataFrame:
    """Length of the wrapped change of two angles per second; 0 at the first row or where no time passed."""
    dt, w = s.seconds(), s.plain()
    turn = F.hypot(wrap_degrees(F.col(yaw) - F.lag(yaw).over(w)), F.col(pitch) - F.lag(pitch).over(w))
    return df.withColumn(out, F.when(dt > 0, turn / dt).otherwise(0.0))


def hysteresis(df: DataFrame, s: Stream, x: str, on: float, off: float, out: str) -> DataFrame:
    """True from the first row above ``on`` to the last before one below ``off``."""
    event = F.when(F.col(x) > on, True).when(F.col(x) < off, False)
    return df.withColumn(out, F.coalesce(last_known(event, s.rows()), F.lit(False)))


def latency_ms(df: DataFrame, s: Stream, active: str, out: str) -> DataFrame:
    """Milliseconds since the state last ended; 0 while it lasts and before it first ended."""
    ended = F.when(~F.col(active) & F.lag(active, 1, False).over(s.plain()), F.col(s.us))
    df = df.withColumn("__end", ended)
    since = (F.col(s.us) - last_known(F.col("__end"), s.rows())) / 1000.0
    return df.withColumn(out, F.when(F.col(active), 0.0).otherwise(F.coalesce(since, F.lit(0.0)))).drop("__end")


def run_length(df: DataFrame, s: Stream, hit: Column, out: str, neutral: Column | None = None) -> DataFrame:
    """Number of hits up to here since the last miss; ``neutral`` rows neither add nor reset."""
    neutral = F.lit(False) if neutral is None else neutral
    df = df.withColumns({"__n": neutral, "__h": hit & ~neutral})
    df = df.withColumn("__g", F.sum(F.when(~F.col("__h") & ~F.col("__n"), 1).otherwise(0)).over(s.rows()))
    w = Window.partitionBy(*s.subject, "__g").orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(F.col("__h"), 1).otherwise(0)).over(w)).drop("__n", "__h", "__g")


def closures(df: DataFrame, s: Stream, run: str, long_run: int) -> DataFrame:
    """``blink``: the first open row after a closed run; ``microsleep``: a closed run of ``long_run`` rows or more."""
    before = F.lag(run, 1, 0).over(s.plain())
    return df.withColumns({"blink": (F.col(run) == 0) & (before > 0), "microsleep": F.col(run) >= long_run})


def closed_ratio(df: DataFrame, s: Stream, closed: Column, rows: int, warm: int, out: str) -> DataFrame:
    """Share of closed rows in the last ``rows``, over no fewer than ``warm``."""
    w = s.rows(1 - rows)
    return df.withColumn(out, F.sum(closed.cast("int")).over(w) / F.greatest(F.count(F.lit(1)).over(w), F.lit(warm)))


def dispersion_held(df: DataFrame, s: Stream, x: str, open_: Column, rows: int, least: int, out: str) -> DataFrame:
    """Population deviation of the last ``rows`` open rows' values (0 below ``least``); other rows hold the last one."""
    df = df.withColumn("__o", open_)
    w = Window.partitionBy(*s.subject, "__o").orderBy(*s.order).rowsBetween(1 - rows, 0)
    spread = F.when(F.count(F.lit(1)).over(w) >= least, F.stddev_pop(x).over(w)).otherwise(0.0)
    df = df.withColumn("__d", F.when(F.col("__o"), spread))
    return df.withColumn(out, F.coalesce(last_known(F.col("__d"), s.rows()), F.lit(0.0))).drop("__o", "__d")


def median_autozero(df: DataFrame, s: Stream, x: str, calm: Column, rows: int, least: int, out: str) -> DataFrame:
    """The value less the median of calm values in the last ``rows`` rows, where they are ``least`` or more."""
    w = s.rows(1 - rows)
    v = F.when(calm, F.col(x))
    base = F.when(F.count(v).over(w) >= least, F.percentile(v, 0.5).over(w)).otherwise(0.0)
    return df.withColumn(out, F.col(x) - base)


def beats(df: DataFrame, s: Stream, speed: str, suppressed: Column, arm: tuple[float, float], fire: float, within: int, least: int) -> DataFrame:
    """Sawtooth beats: a slow inward speed in ``arm`` arms, a fast outward one fires once; ``detected`` from ``least`` beats in
    ``within`` microseconds, then with the speed of the last drift as ``drift``."""
    v = F.col(speed)
    event = F.when(suppressed, 0).when(v.between(*arm), 1).when(v <= -fire, 2)
    df = df.withColumn("__e", event).withColumn("__before", F.last("__e", ignorenulls=True).over(s.rows(None, -1)))
    df = df.withColumn("beat", F.coalesce((F.col("__e") == 2) & (F.col("__before") == 1), F.lit(False)))
    count = F.sum(F.col("beat").cast("int")).over(s.range(-within))
    df = df.withColumn("beat_count", count).withColumn("detected", F.col("beat_count") >= least)
    drift = last_known(F.when(F.col("__e") == 1, v), s.rows())
    return df.withColumn("drift", F.when(F.col("detected"), drift).otherwise(0.0)).drop("__e", "__before")


def fragmentation(df: DataFrame, s: Stream, flag: Column, within: int, least: int, out: str) -> DataFrame:
    """Share of flagged rows in the last ``within`` microseconds, 0 with fewer than ``least`` rows."""
    w = s.range(-within)
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) >= least, F.avg(flag.cast("double")).over(w)).otherwise(0.0))


def detrended_spread(df: DataFrame, s: Stream, x: str, within: int, least: int, out: str) -> DataFrame:
    """Population deviation of the residuals of a straight line over the last ``within`` microseconds."""
    w = s.range(-within)
    t = (F.col(s.us) - F.min(s.us).over(s.whole())) / float(SECOND)
    df = df.withColumn("__t", t)
    vy = F.var_pop(x).over(w)
    c, vt = F.covar_pop(x, "__t").over(w), F.var_pop("__t").over(w)
    rest = F.when(vt > 0, vy - c * c / vt).otherwise(vy)
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) >= least, F.sqrt(F.greatest(rest, F.lit(0.0)))).otherwise(0.0)).drop("__t")


def first_n_median(df: DataFrame, s: Stream, x: str, n: int, out: str) -> DataFrame:
    """The median of a subject's first ``n`` values, once there are ``n``."""
    df = df.withColumn("__i", F.row_number().over(s.plain()))
    base = F.percentile(F.when(F.col("__i") <= n, F.col(x)), 0.5).over(s.whole())
    return df.withColumn(out, F.when(F.col("__i") >= n, base)).drop("__i")


def reversal_frequency(df: DataFrame, s: Stream, x: str, low: float, high: float, within: int, valid: int, out: str) -> DataFrame:
    """Half the sign flips per second between neighbouring steps of size in (low, high), over ``within`` microseconds."""
    df = df.withColumn("__d", F.col(x) - F.lag(x).over(s.plain()))
    size = F.abs("__d")
    df = df.withColumn("__v", F.coalesce((size > low) & (size < high), F.lit(False)))
    flip = F.col("__v") & F.lag("__v", 1, False).over(s.plain()) & (F.signum("__d") * F.signum(F.lag("__d").over(s.plain())) < 0)
    df = df.withColumn("__f", flip.cast("int"))
    w = s.range(-within)
    lasts = (F.col(s.us) - F.min(s.us).over(w)) / float(SECOND)
    ok = (F.sum(F.col("__v").cast("int")).over(w) >= valid) & (lasts > 0)
    return df.withColumn(out, F.when(ok, F.sum("__f").over(w) / (2 * lasts)).otherwise(0.0)).drop("__d", "__v", "__f")


def tremor(df: DataFrame, s: Stream, x: str, usable: Column, low: float, high: float, within: int, shake: str, out: str, rows: int = 12, least_s: float = 0.4, valid: int = 6) -> DataFrame:
    """Half the sign flips per second among usable rows alone; 0 on others, with few rows or little time; damped while shaking.

    Vibration over 0.35 takes its share off. Two digits, halves to even.
    """
    df = df.withColumn("__u", F.coalesce(usable, F.lit(False)))
    own_rows = Window.partitionBy(*s.subject, "__u").orderBy(*s.order)
    own_time = Window.partitionBy(*s.subject, "__u").orderBy(s.us).rangeBetween(-within, 0)
    df = df.withColumn("__d", F.col(x) - F.lag(x).over(own_rows))
    df = df.withColumn("__v", F.coalesce((F.abs("__d") > low) & (F.abs("__d") < high), F.lit(False)))
    flip = F.col("__v") & F.lag("__v", 1, False).over(own_rows) & (F.signum("__d") * F.signum(F.lag("__d").over(own_rows)) < 0)
    df = df.withColumn("__f", F.coalesce(flip, F.lit(False)).cast("int"))
    lasts = (F.col(s.us) - F.min(s.us).over(own_time)) / float(SECOND)
    enough = F.col("__u") & (F.count(F.lit(1)).over(own_time) >= rows) & (lasts >= least_s) & (F.sum(F.col("__v").cast("int")).over(own_time) >= valid)
    hz = F.sum("__f").over(own_time) / (2 * lasts) * F.when(F.col(shake) > 0.35, F.greatest(F.lit(0.0), 1 - F.col(shake))).otherwise(1.0)
    return df.withColumn(out, F.when(enough, F.bround(hz, 2)).otherwise(0.0)).drop("__u", "__d", "__v", "__f")


def window_tremor(df: DataFrame, keys: list[str], order: str, x: str, frames: int, low: float = 0.001, high: float = 0.045, rate: float = 30.0) -> DataFrame:
    """Flips per second of each window of ``frames`` rows, at a fixed rate: (keys, tremor); 0 for fewer than 12 rows or 6 steps."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("__d", F.col(x) - F.lag(x).over(w))
    df = df.withColumn("__v", F.coalesce((F.abs("__d") > low) & (F.abs("__d") < high), F.lit(False)))
    flip = F.col("__v") & F.lag("__v", 1, False).over(w) & (F.signum("__d") * F.signum(F.lag("__d").over(w)) < 0)
    got = df.withColumn("__f", F.coalesce(flip, F.lit(False)).cast("int")).groupBy(*keys).agg(F.count("*").alias("__n"), F.sum(F.col("__v").cast("int")).alias("__steps"), F.sum("__f").alias("__flips"))
    enough = (F.col("__n") >= 12) & (F.col("__steps") >= 6)
    return got.select(*keys, F.when(enough, F.bround(F.col("__flips") / (2 * max(frames / rate, 0.4)), 2)).otherwise(0.0).alias("tremor"))


def crossings(values: Column) -> Column:
    """Crossings of an array's values about its mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    signs = F.transform(F.array(F.struct(values.alias("v"), mean.alias("m"))), lambda b: F.transform(b["v"], lambda v: F.signum(v - b["m"])))[0]
    nonzero = F.filter(signs, lambda g: g != 0)
    return F.size(F.filter(F.zip_with(nonzero, F.slice(nonzero, 2, 1_000_000), lambda a, b: F.coalesce(a * b < 0, F.lit(False))), lambda c: c))


def cadence(df: DataFrame, s: Stream, x: str, within: int, least: int, level: tuple[float, float], spread: float, reach: float, top: float, rate: float, out: str) -> DataFrame:
    """True where the values of the last ``within`` microseconds swing like speech: mean, deviation, range, top and mean
    crossings a second all within their bounds, over ``least`` rows or more."""
    w = s.range(-within)
    df = df.withColumns({"__a": F.transform(F.sort_array(F.collect_list(F.struct(s.us, *([s.tie] if s.tie else []), x)).over(w)), lambda v: v[x]), "__m": F.avg(x).over(w), "__sd": F.stddev_pop(x).over(w), "__hi": F.max(x).over(w), "__r": F.max(x).over(w) - F.min(x).over(w), "__t": (F.col(s.us) - F.min(s.us).over(w)) / float(SECOND)})
    hit = (F.size("__a") >= least) & F.col("__m").between(*level) & (F.col("__sd") >= spread) & (F.col("__r") >= reach) & (F.col("__hi") >= top) & (crossings(F.col("__a")) >= rate * F.col("__t"))
    return df.withColumn(out, hit).drop("__a", "__m", "__sd", "__hi", "__r", "__t")


def widening(df: DataFrame, s: Stream, x: str, least: float, within: int, low: float, rise: float, out: str) -> DataFrame:
    """A spike: the value is over ``least`` and the recent minimum was low or is far below."""
    recent = F.min(x).over(s.range(-within))
    return df.withColumn(out, (F.col(x) > least) & ((recent < low) | (F.col(x) - recent > rise)))


def suppressed_for(df: DataFrame, s: Stream, event: Column, out: str) -> DataFrame:
    """Seconds since the last event, or since the subject's first row."""
    seen = F.coalesce(last_known(F.when(event, F.col(s.us)), s.rows()), F.min(s.us).over(s.whole()))
    return df.withColumn(out, (F.col(s.us) - seen) / float(SECOND))


def event_rate(df: DataFrame, s: Stream, event: Column, within: int, least: int, out: str) -> DataFrame:
    """Events in the last ``within`` microseconds per unit of it that has passed, 0 with fewer than ``least``."""
    n = F.sum(event.cast("int")).over(s.range(-within))
    passed = F.least(F.lit(float(within)), (F.col(s.us) - F.min(s.us).over(s.whole())).cast("double")) / within
    return df.withColumn(out, F.when((n >= least) & (passed > 0), n / passed).otherwise(0.0))


def quadratic_acceleration(df: DataFrame, s: Stream, x: str, rows: int, out: str) -> DataFrame:
    """Twice the leading coefficient of the least-squares parabola through the last ``rows`` rows (three at least)."""
    w = s.rows(1 - rows)
    # Times count from the current row's window middle in units of the window, so sums of powers stay small.
    df = df.withColumns({"__ts": F.collect_list(F.col(s.us)).over(w), "__xs": F.collect_list(F.col(x).cast("double")).over(w)})
    scaled = F.transform("__ts", lambda t: (t - F.element_at("__ts", 1)) / float(SECOND))
    df = df.withColumn("__u", scaled)
    total = lambda f: F.aggregate(F.zip_with("__u", "__xs", f), F.lit(0.0), lambda a, v: a + v)
    n = F.size("__u").cast("double")
    s1, s2, s3, s4 = total(lambda u, _: u), total(lambda u, _: u * u), total(lambda u, _: u * u * u), total(lambda u, _: u * u * u * u)
    y0, y1, y2 = total(lambda u, v: v), total(lambda u, v: u * v), total(lambda u, v: u * u * v)
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    top = n * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s3 * y0) + s2 * (s1 * y1 - s2 * y0)
    return df.withColumn(out, F.when((n >= 3) & (det != 0), 2 * top / det).otherwise(0.0)).drop("__ts", "__xs", "__u")


def jitter(df: DataFrame, s: Stream, x: str, rows: int, out: str) -> DataFrame:
    """The value less the mean of the last ``rows``."""
    return df.withColumn(out, F.col(x) - F.avg(x).over(s.rows(1 - rows)))


def vibration_score(df: DataFrame, s: Stream, x: str, rows: int, noise: float, full: float, out: str) -> DataFrame:
    """Share of sign reversals among moves over ``noise``, times their root mean square over ``full``, in [0, 1]."""
    df = df.withColumn("__a", F.collect_list(x).over(s.rows(1 - rows)))
    moves = F.filter("__a", lambda v: F.abs(v) > noise)
    df = df.withColumn("__m", moves)
    flips = F.size(F.filter(F.zip_with("__m", F.slice("__m", 2, rows), lambda a, b: F.coalesce(a * b < 0, F.lit(False))), lambda c: c))
    rms = F.sqrt(F.aggregate("__a", F.lit(0.0), lambda a, v: a + v * v) / F.size("__a"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), flips / F.greatest(F.size("__m") - 1, F.lit(1)) * rms / full))
    return df.withColumn(out, F.when((F.size("__a") >= 6) & (F.size("__m") >= 4), score).otherwise(0.0)).drop("__a", "__m")


# ---------------------------------------------------------------- gaps and windows


def drop_gated(df: DataFrame, gated: Column) -> DataFrame:
    return df.where(~gated)


def hold_last(df: DataFrame, s: Stream, columns: list[str], gated: Column) -> DataFrame:
    """Gated rows take the last valid row's numbers; before any valid row they keep their own."""
    df = df.withColumn("__g", gated)
    return df.withColumns({c: F.coalesce(last_known(F.when(~F.col("__g"), F.col(c)), s.rows()), F.col(c)) for c in columns}).drop("__g")


def interpolate_gated(df: DataFrame, s: Stream, x: str, gated: Column, kept: int = 2) -> DataFrame:
    """Gated rows between valid ones take values on the line between them by position; the last ``kept`` rows of a gap stay.

    A gap at the start takes the first valid value; one at the end is not emitted.
    """
    df = df.withColumns({"__g": gated, "__i": F.row_number().over(s.plain())})
    good = lambda c: F.when(~F.col("__g"), F.col(c))
    after = s.plain().rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumns({
        "__p": last_known(good(x), s.rows()), "__pi": last_known(good("__i"), s.rows()),
        "__n": F.first(good(x), ignorenulls=True).over(after), "__ni": F.first(good("__i"), ignorenulls=True).over(after),
    })
    gap = F.least(F.col("__ni") - F.coalesce("__pi", F.lit(0)) - 1, F.lit(kept))
    place = gap - (F.col("__ni") - F.col("__i")) + 1
    line = F.col("__p") + (F.col("__n") - F.col("__p")) * place / (gap + 1)
    value = F.when(~F.col("__g"), F.col(x)).otherwise(F.coalesce(line, F.col("__n")))
    keep = ~F.col("__g") | (F.col("__ni") - F.col("__i") <= kept)
    return df.where(F.col("__ni").isNotNull() & keep).withColumn(x, value).drop("__g", "__i", "__p", "__pi", "__n", "__ni")


def sliding_windows(df: DataFrame, s: Stream, length: int, stride: int, slack: int = 100) -> DataFrame:
    """Each row once per window it lies in (window_id, window_start, pos); windows start at the subject's first row.

    A window holds both of its ends, and the last one ends no later than the subject's last row plus ten ``slack``.
    The windows of a row follow from its time by arithmetic, so nothing is joined.
    """
    df = df.withColumns({"__t0": F.min(s.us).over(s.whole()), "__t1": F.max(s.us).over(s.whole())})
    at = F.col(s.us) - F.col("__t0")
    low = F.greatest(F.ceil((at - length - slack) / stride), F.lit(0))
    high = F.least(F.floor((at + slack) / stride), F.floor((F.col("__t1") + 10 * slack - F.col("__t0") - length) / stride))
    df = df.withColumns({"__lo": low.cast("bigint"), "__hi": high.cast("bigint")}).where("__hi >= __lo")
    df = df.withColumn("window_id", F.explode(F.sequence("__lo", "__hi")))
    df = df.withColumn("window_start", F.col("__t0") + F.col("window_id") * stride)
    w = Window.partitionBy(*s.subject, "window_id").orderBy(*s.order)
    return df.withColumn("pos", F.row_number().over(w) - 1).drop("__t0", "__t1", "__lo", "__hi")


def resample(df: DataFrame, keys: list[str], pos: str, x: str, target: int) -> DataFrame:
    """Each key's values at ``target`` even places of [0, 1], on the lines between neighbours (keys, place, x)."""
    got = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(x).cast("double").alias("v")))).alias("__a"))
    got = got.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(target - 1))))
    at = F.col("place") * (F.size("__a") - 1) / F.lit(float(max(1, target - 1)))
    left = F.floor(at).cast("int")
    a = F.get("__a", left)["v"]
    b = F.get("__a", F.least(left + 1, F.size("__a") - 1))["v"]
    return got.select(*keys, "place", (a + (b - a) * (at - left)).alias(x))


def first_rows(df: DataFrame, subject: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each subject with their number, from 1: a window group limit, so no more than that are sorted on."""
    w = Window.partitionBy(*subject).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
