"""Names, labels and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the first letter of a category stands for.
FAMILIES = {
    "p": "prohibitory (proibição/regulamentação)",
    "i": "indication/mandatory (indicação, azul)",
    "w": "warning (advertência, triangular)",
}
SPLITS = ("train", "test", "other")


def split_from_path(path: Column) -> Column:
    """The folder before the first slash if it is a known split, else ``unknown``."""
    head = F.substring_index(path, "/", 1)
    return F.when(F.contains(path, F.lit("/")) & head.isin(*SPLITS), head).otherwise("unknown")


def split_of(path: Column) -> Column:
    """Looser: any folder of the path, either slash, any case; train, test, val, then other."""
    clean = F.concat(F.lit("/"), F.lower(F.replace(path, F.lit("\\"), F.lit("/"))))
    out = F.when(F.contains(clean, F.lit("/train/")), "train")
    for name in ("test", "val", "other"):
        out = out.when(F.contains(clean, F.lit(f"/{name}/")), name)
    return out.otherwise("unknown")


def prefix(name: Column) -> Column:
    """What comes before the first digit; the whole name if that is nothing."""
    head = F.regexp_extract(name, r"^([^0-9]+)", 1)
    return F.when(head == "", name).otherwise(head)


def letters(name: Column) -> Column:
    """The leading Latin letters; the whole name if there are none."""
    head = F.regexp_extract(name, r"^([A-Za-z]+)", 1)
    return F.when(head == "", name).otherwise(head)


def family(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.substring(name, 1, 1)), F.lit("other/misc"))


def sign_shape(name: Column) -> Column:
    """The order matters: ``il`` before ``i``."""
    return F.when(name.startswith("w"), "triangle").when(name.startswith("il"), "circle").when(name.startswith("i"), "rectangle").otherwise("circle")


def sha1_mod_1000(text: Column) -> Column:
    """sha1 as an integer modulo 1000, from four chunks of ten hex digits (16 ** 10 mod 1000 = 776)."""
    out = F.lit(0).cast("long")
    digest = F.sha1(text)
    for k in range(4):
        out = (out * 776 + F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("long")) % 1000
    return out


def keep_negative(name: Column, fraction: float) -> Column:
    return F.lit(False) if fraction <= 0 else sha1_mod_1000(name) < F.lit(fraction * 1000)


def budget_tag(k: Column) -> Column:
    """``bm`` and the hundredfold in three digits; raises outside 0.01 to 9.99."""
    return F.when((k >= 0.01) & (k <= 9.99), F.format_string("bm%03d", F.bround(k * 100, 0).cast("int"))).otherwise(F.raise_error(F.lit("budget out of range")).cast("string"))


def is_budget_tag(tag: Column) -> Column:
    return tag.rlike(r"^bm[0-9]{3}$")


def parse_budget_tag(tag: Column) -> Column:
    return F.when(is_budget_tag(tag), F.substring(tag, 3, 3).cast("int") / 100.0).otherwise(F.raise_error(F.lit("not a budget tag")).cast("double"))


def experiment_name(arm: Column, seed: Column, tag: Column | None = None, smoke: Column | None = None) -> Column:
    """arm[_tag]_seedN[_smoke]; raises on a negative seed."""
    tagged = arm if tag is None else F.when(F.coalesce(tag, F.lit("")) == "", arm).otherwise(F.concat(arm, F.lit("_"), tag))
    end = F.lit("") if smoke is None else F.when(F.coalesce(smoke, F.lit(False)), "_smoke").otherwise("")
    return F.when(seed >= 0, F.concat(tagged, F.lit("_seed"), seed.cast("string"), end)).otherwise(F.raise_error(F.lit("negative seed")).cast("string"))


def run_id(dataset: Column, arm: Column, seed: Column, tag: Column | None = None, smoke: Column | None = None) -> Column:
    return F.concat(dataset, F.lit("_"), experiment_name(arm, seed, tag, smoke))


RUN_FORMAT = r"^([a-z0-9_]+?)(?:_(bm[0-9]{3}))?_seed([0-9]+)(_smoke)?$"


def parse_run_dir(name: Column) -> Column:
    """arm, budget_tag (null if there is none), seed, smoke of a run's folder; null if it is not one."""
    arm, tag, seed, smoke = (F.regexp_extract(name, RUN_FORMAT, i) for i in range(1, 5))
    return F.when(name.rlike(RUN_FORMAT), F.struct(arm.alias("arm"), F.nullif(tag, F.lit("")).alias("budget_tag"), seed.cast("int").alias("seed"), (smoke != "").alias("smoke")))


def display_arm(arm: Column, tag: Column) -> Column:
    return F.when(F.coalesce(tag, F.lit("")) == "", arm).otherwise(F.concat(arm, F.lit("_"), tag))


def number(x: Column, digits: int = 4) -> Column:
    return F.when(x.isNull() | F.isnan(x), "n/a").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def duration(seconds: Column) -> Column:
    """Hours and minutes, or minutes and seconds below one hour."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return F.when(h > 0, F.format_string("%dh%02dm", h, m)).otherwise(F.format_string("%dm%02ds", m, s % 60))


def interval(mean: Column, low: Column, high: Column) -> Column:
    return F.format_string("%+.4f [%+.4f, %+.4f]", mean, low, high)


def ci_excludes_zero(low: Column, high: Column) -> Column:
    return (low > 0) | (high < 0)


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def steps_per_epoch(n: Column, batch: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(n / batch))


def epochs_for_budget(steps: Column, per_epoch: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.bround(steps / per_epoch, 0).cast("long"))
