"""URL filter: host and path rules first, then logistic regression on hashed n-grams.

The model is trained by Spark ML on a small table of labelled URLs; its features
are hashed character n-grams of host and path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import Scratch

# The names that a small labelled table is made of: sites that a corpus should not hold, and others.
BLOCK_NAMES = (
    "casino-royal bigcasino win-casino casino-online poker-win winbets bets-free freebet free-spins sports-betting "
    "pills-online cheapmeds cheap-drugs pharma-pills diet-pills cheap-pharmacy adult-video xadult adult-dating "
    "xxx-adult adults-only spam-mail spamlinks buy-spam link-farm content-farm click-farm ads-server adsclick "
    "track-ads tracking tracker user-track free-loans cheap-loans free-movies win-prize malware-kit win-phone "
    "ads-network ads-media click-track track-pixel adserve "
    "roulette jackpot slots-online blackjack-games lottery-winner gambling-site payday-loan instant-loan replica-watches "
    "porn-tube camgirls escorts-city hookup-now sexy-girls viagra-online steroids-shop weightloss-pills rx-pharmacy "
    "popup-ads banner-ads adnetwork doubleads pixel-tracker clicktracker spam-bot spammer bulk-spam mass-mail phishing "
    "keygen-cracks warez-zone torrent-free crypto-doubler get-rich-quick betting-odds sportsbet bookmaker-bets poker-room"
).split()
ALLOW_NAMES = (
    "library mountains history science gardening nature weather teaching museum edition recipes music journal "
    "astronomy travel school tionhe anderst thenre oningan erethha tiereur stinter ouanthe hethanti thouree "
    "ationle erntha inganre ndorthe news-today open-data city-guide book-club free-software "
    "winter farmers address adulthood "
    "biology physics geography algebra geometry literature painting theatre cinema opera ballet concert festival "
    "government ministry parliament council village mountain-club river forest garden-society birdwatching fishing "
    "bicycle cycling football tennis swimming athletics chess bridge knitting pottery carpentry woodwork blacksmith "
    "bakery kitchen restaurant vegetables cheese coffee tea-house vineyard brewery farmers-market orchard beekeeping "
    "medicine nursing dentist surgery pediatrics psychology therapy nutrition public-health ambulance firefighters "
    "engineering mechanics electronics robotics software programming databases networks statistics economics finance "
    "accounting insurance logistics transport airline airport harbour shipping aviation satellite telescope planetarium "
    "archive manuscripts dictionary encyclopedia grammar translation linguistics folklore mythology archaeology "
    "anthropology sociology theology law-review human-rights charity volunteers refugees childcare playground "
    "newspaper magazine broadcasting documentary photography design typography illustration fashion textiles jewellery "
    "energy solar windpower hydrology climate oceanography marine-biology zoology veterinary horses dogs cats aquarium"
).split()


def labelled_names(block: list[str] = BLOCK_NAMES, allow: list[str] = ALLOW_NAMES) -> list[tuple[str, float]]:
    """URLs of each name with common beginnings, domains and paths, which then tell nothing; label 1 for block."""
    rows = []
    for names, label in ((block, 1.0), (allow, 0.0)):
        for i, name in enumerate(names):
            for j, start in enumerate(("", "www.", "m.", "blog.")):
                for k, domain in enumerate(("com", "net", "org")):
                    language = ("en", "de", "fr", "es")[(i + j + k) % 4]
                    rows.append((f"http://{start}{name}.example.{domain}/{language}/{(i + 1) * (3 * j + k + 1) * 37}", label))
    return rows


_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def with_parts(urls: DataFrame) -> DataFrame:
    """``urls`` with ``host`` and ``path``; both empty for a null or a text without ``://``."""
    url = F.coalesce("url", F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return urls.withColumns({
        "host": F.translate(host, _AZ, _AZ.lower()),
        "path": F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1),
    })


def ruled(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls`` (with host and path) with ``rule`` and its ``ruling``, null where no rule fits; the longest wins.

    The rules are a short list: they become one expression.
    """
    rule = ruling = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, ruling = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(ruling)
    return urls.withColumns({"rule": rule, "ruling": ruling})


def _grams(text: Column, mark: str, sizes: tuple[int, ...]) -> Column:
    """n-grams of a text between marks; texts shorter than n give none."""
    whole = F.concat(F.lit("^"), text, F.lit("$"))
    each = [
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))),
            lambda i, n=n: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))),
        )
        for n in sizes
    ]
    return F.concat(*each)


def with_features(urls: DataFrame, sizes: tuple[int, ...] = (3, 4), features: int = 1 << 14) -> DataFrame:
    """``urls`` (with host and path) with ``_features``: presence of hashed n-grams."""
    grams = F.concat(_grams(F.col("host"), "h", sizes), _grams(F.col("path"), "p", sizes))
    hashed = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features, binary=True)
    return hashed.transform(urls.withColumn("_grams", grams)).drop("_grams")


def labelled_sample(urls: DataFrame, rules: list[Rule], most: int = 5000) -> DataFrame:
    """At most ``most`` URLs that a rule decides, with ``label`` 1 for block: those with the smallest hashes."""
    known = ruled(with_parts(urls.select("url")), rules).where("rule is not null")
    known = known.select("url", (F.col("ruling") == "block").cast("double").alias("label"))
    return known.orderBy(F.xxhash64("url"), "url").limit(most)


def train(labelled: DataFrame, penalty: float = 0.001, steps: int = 50, **features) -> LogisticRegressionModel | None:
    """A model from a small table (url, label); None if there are no rows.

    Null urls or labels are left out. The model has one weight for each of the
    hashed features, whatever the size of the table.
    """
    rows = with_parts(labelled.where("url is not null and label is not null").select("url", "label"))
    rows = with_features(rows, **features).select("_features", F.col("label").cast("double").alias("label"))
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return None
    # both labels weigh the same, however many rows they have
    weight = F.lit(0.0)
    for label, count in sizes.items():
        weight = F.when(F.col("label") == label, sum(sizes.values()) / (len(sizes) * count)).otherwise(weight)
    learner = LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="weight", regParam=penalty, maxIter=steps, standardization=False
    )
    return learner.fit(rows.withColumn("weight", weight))


def classify(
    urls: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, threshold: float = 0.5, **options
) -> DataFrame:
    """``page_id``, host, path, rule, verdict and the model's probability of ``block`` for each row.

    ``labelled`` (url, label) trains the model; by default it is ``labelled_names``;
    ``labelled_sample`` makes a table of what the rules decide. The verdict is the rule's, else the model's, else
    ``allow`` if there is nothing to learn from. Repeated rows stay; a null url
    has an empty host and path and is judged by the model; other columns are ignored.
    """
    scratch = Scratch(urls.sparkSession, "urls")
    if labelled is None:
        labelled = urls.sparkSession.createDataFrame(labelled_names(), "url string, label double")
    model = train(scratch.table(labelled.select("url", "label"), "labelled"), **options)
    judged = ruled(with_parts(urls.select(F.col("page_id").cast("bigint").alias("page_id"), "url")), rules)
    features = {k: v for k, v in options.items() if k in ("sizes", "features")}
    if model is None:
        judged = judged.withColumn("probability", F.lit(None).cast("double"))
    else:
        judged = model.setProbabilityCol("_p").transform(with_features(judged, **features))
        judged = judged.withColumn("probability", F.round(F.get(vector_to_array("_p"), F.lit(1)), 6))
    learnt = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruling", learnt).alias("verdict"), "probability")
