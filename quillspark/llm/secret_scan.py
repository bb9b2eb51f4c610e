"""Secrets by a random forest over candidate strings, in built-in functions alone.

Every long run of letters and digits in a word is a candidate, and shorter runs or runs of letters alone where a
credential's name stands before them. Its length, character
transitions, dictionary coverage, path and neighbouring words go through a forest trained
on labelled findings, which sorts out hashes, identifiers and placeholders. The
forest becomes an SQL expression, so scanning is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 16
_SET = "0-9A-Za-z+/_-"
#: A run with its padding, and what stands before it in its word; a = that goes on is an assignment.
_CORE = f"[{_SET}]+(?:=+(?![={_SET}]))?"
#: A text without such a run has no candidate but beside credentials.
_RUN = r"(?=[A-Za-z+/_-]{0,64}[0-9])(?=[0-9+/_-]{0,64}[A-Za-z])[0-9A-Za-z+/_-]{%d,}" % LEAST

# Words that stand beside secrets, beside other long strings, and in paths of tests and examples.
BESIDE = "password|passwd|pwd|secret|token|api[_-]?key|apikey|auth|bearer|credential|access[_-]?key|private|login"
NAMED = r"(password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)[0-9]*([_-][0-9a-z_-]*)?[\"\'\])]*\s*(=|:|=>|:=|->)\s*[\"\']*$|bearer\s+$"
ELSEWHERE = "commit|checksum|digest|md5|sha1|sha256|sha-256|hash|uuid|guid|etag|revision|version|build|order|invoice|file|image|blob|integrity"
PLACEHOLDER = "example|sample|dummy|changeme|your|placeholder|xxxx|test|fake|lorem|insert"
PATHS = "test|example|sample|fixture|mock|demo|docs?/"
# Beginnings that issuers give to their keys.
ISSUED = "AKIA|ASIA|AIza|ghp_|gho_|github_pat_|xox[abp]-|sk-|sk_live_|eyJ|glpat-|npm_"
# Common words and word parts; what they cover of a candidate is readable.
DICTIONARY = (
    "the and for with that this from have get set user name value count item list page order file image data date time key "
    "token password secret example sample test your here new old first last final report version index table column window "
    "button event handler manager factory service client server request response message string number object array config "
    "option default update delete create insert select read write open close start stop begin end next prev total size width "
    "height color style font text title label error warning info debug trace ing tion ment able ness ight ould ance ence"
).split()

FEATURES = ("length", "transitions", "digits", "capitals", "distinct", "hexadecimal", "coverage", "separators", "issued", "beside", "elsewhere", "placeholder", "path", "quoted", "assigned")


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def candidate_sql(text: str, path: str) -> str:
    """Every candidate of ``text``: its place among the words, itself, and what stands around it."""
    sql = lambda x: x.replace("\\", "\\\\").replace("'", "\\'")
    named, beside = sql(NAMED), f"(?i){BESIDE}"
    near = f"named AND concat_ws(' ', get(w, i - 2), get(w, i - 1), w[i]) rlike '{beside}'"
    # the word's runs, each with what stands before it; a comma, semicolon or & ends what belongs to an earlier run
    runs = f"regexp_extract_all(w[i], '[^{_SET}]*{_CORE}', 0)"
    prefix = f"concat(array_join(slice(m, 1, k), ''), regexp_extract(m[k], '^[^{_SET}]*', 0))"
    last = "regexp_extract(p, '[^,;&]*$', 0)"
    before = f"lower(concat_ws(' ', IF(p rlike '[,;&]', null, get(w, i - 2)), IF(p rlike '[,;&]', null, get(w, i - 1)), regexp_replace({last}, '[\\'\"]+$', '')))"
    own = f"struct(i AS place, regexp_extract(m[k], '{_CORE}', 0) AS core, w[i] AS word, {_let(prefix, 'p', before)} AS before, lower(coalesce(get(w, i + 1), '')) AS after, lower(coalesce({path}, '')) AS path)"
    kept = f"c -> (length(c.core) >= {LEAST} AND c.core rlike '{_RUN}') OR (named AND (c.before rlike '{named}' OR (length(c.core) >= {LEAST} AND c.before rlike '{BESIDE}')))"
    each = _let(runs, "m", f"filter(transform(sequence(0, size(m) - 1), k -> {own}), {kept})")
    words = f"split({text}, '[ \\\\t\\\\n\\\\r\\\\f]+')"
    found = f"filter(sequence(0, size(w) - 1), i -> w[i] rlike '[{_SET}]' AND ((length(w[i]) >= {LEAST} AND w[i] rlike '{_RUN}') OR ({near})))"
    every = _let(words, "w", f"flatten(transform({found}, i -> {each}))")
    return f"CASE WHEN {text} rlike '{_RUN}' OR {text} rlike '{beside}' THEN {_let(f"{text} rlike '{beside}'", 'named', every)} ELSE array() END"


def feature_sql(c: str) -> dict[str, str]:
    core, low = f"{c}.core", f"lower({c}.core)"
    words = "|".join(sorted(DICTIONARY, key=lambda x: (-len(x), x)))
    flag = lambda test: f"cast({test} AS INT)"
    share = lambda kept: f"length(regexp_replace({core}, '[^{kept}]', '')) / length({core})"
    change = "(?<=[a-z])(?=[0-9A-Z])|(?<=[0-9])(?=[a-zA-Z])|(?<=[A-Z])(?=[0-9])"
    return {
        "length": f"least(length({core}), 200)",
        "transitions": f"(length(regexp_replace({core}, '{change}', '|')) - length({core})) / length({core})",
        "digits": share("0-9"),
        "capitals": share("A-Z"),
        "distinct": f"size(array_distinct(split({core}, ''))) / least(length({core}), 40)",
        "hexadecimal": flag(f"{core} rlike '^[0-9a-f-]+$'"),
        "coverage": f"1 - length(regexp_replace({low}, '{words}', '')) / length({core})",
        "separators": f"length(regexp_replace({core}, '[^_/-]', '')) / length({core})",
        "issued": flag(f"{core} rlike '^({ISSUED})'"),
        "beside": flag(f"{c}.before rlike '{BESIDE}'"),
        "elsewhere": flag(f"concat_ws(' ', {c}.before, {c}.after) rlike '({ELSEWHERE})'"),
        "placeholder": flag(f"{low} rlike '{PLACEHOLDER}'"),
        "path": flag(f"{c}.path rlike '{PATHS}'"),
        "quoted": flag(f"{c}.word rlike '[\"\\']'"),
        "assigned": flag(f"{c}.before rlike '[=:]'"),
    }


def labelled_findings(spark: SparkSession, n: int = 4200, first: int = 0, without: tuple[int, ...] = (), only: tuple[int, ...] = ()) -> DataFrame:
    """``n`` labelled findings made by rule: keys, passwords and tokens (1); hashes, identifiers, placeholders and names (0).

    ``first`` numbers them, other numbers give other strings; kinds ``without`` are left out, as are all others where there are ``only`` some.
    Findings that aren't secrets stand more often in paths of tests and examples. Every finding is a candidate of its sentence; a sentence
    that holds none gives no row.
    """
    hexes = lambda k: f"sha2(concat('{k}', id), 256)"
    base36 = lambda k, n: f"substring(concat({', '.join(f'conv(substring({hexes(k)}, {p}, 12), 16, 36)' for p in (1, 13, 25, 37, 49))}), 1, {n})"
    base64 = lambda k, n: f"translate(substring(base64(unhex({hexes(k)})), 1, {n}), '+/=', 'xyz')"
    filler = "element_at(array('ondre', 'thation', 'of', 'eauque', 'was', 'schung', 'the', 'ciones', 'pour', 'inhe'), cast(pmod(xxhash64(id, {k}), 10) AS INT) + 1)"
    a, b = filler.format(k=1), filler.format(k=2)
    plain = lambda word, label: (f"concat({a}, ' ', {b}, ' ', {word})", label)
    named = lambda name, word, label: (f"concat({a}, ' {name}', {word})", label)
    upper = lambda k, n: f"upper({base36(k, n)})"
    camel = "concat(element_at(array('getUser', 'setOrder', 'listItem', 'readFile', 'openPage', 'createEvent', 'updateIndex'), cast(pmod(id, 7) AS INT) + 1), element_at(array('Name', 'Value', 'Handler', 'Message', 'Config'), cast(pmod(id, 5) AS INT) + 1), element_at(array('List', 'Factory', 'Service', 'Window'), cast(pmod(id, 4) AS INT) + 1), cast(pmod(id, 97) AS STRING))"
    letters = lambda k, n: f"translate({base64(k, n)}, '0123456789', 'QwErTyUiOp')"
    value = "element_at(array('required', 'string', 'None', 'true', 'optional', 'changeme', 'bearer', 'the', 'missing', 'invalid', 'hidden', 'yes'), cast(pmod(xxhash64(id, 'v'), 12) AS INT) + 1)"
    long = "element_at(array('internationalization', 'authenticationservice', 'refreshTokenHandler', 'your_secret_goes_here', 'configuration-manager'), cast(pmod(xxhash64(id, 'w'), 5) AS INT) + 1)"
    uuid = f"regexp_replace(substring({hexes('u')}, 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')"
    kinds = [
        plain(f"concat('AKIA', {upper('a', 16)})", 1),
        named("password=", f"substring({hexes('b')}, 1, 18)", 1),
        named('token = "', f"concat(substring({hexes('c')}, 1, 40), '\"')", 1),
        named("api_key: ", base64("d", 32), 1),
        plain(f"concat('ghp_', {base64('e', 36)})", 1),
        named("secret=", base64("f", 24), 1),
        named("Authorization: Bearer ", base64("g", 43), 1),
        named("commit ", f"substring({hexes('h')}, 1, 40)", 0),
        plain(uuid, 0),
        named("sha256 checksum ", hexes("i"), 0),
        plain(camel, 0),
        named("password=", "concat('yourexamplepassword', cast(pmod(id, 10) AS STRING))", 0),
        named("token: ", "concat('insert_your_token_here_', cast(pmod(id, 100) AS STRING))", 0),
        plain("concat('report_', cast(2000 + pmod(id, 30) AS STRING), '_final_version_', cast(pmod(id, 9) AS STRING))", 0),
        plain(f"substring({hexes('j')}, 1, 32)", 0),
        named("order ", upper("k", 18), 0),
        plain("concat('window-manager-service-', cast(pmod(id, 1000) AS STRING), '-option')", 0),
        named("password=", f"substring({hexes('m')}, 1, 8 + cast(pmod(xxhash64(id, 'n'), 8) AS INT))", 1),
        named("password: ", f"substring({base64('o', 16)}, 1, 8 + cast(pmod(xxhash64(id, 'p'), 8) AS INT))", 1),
        named("AWS_SECRET_ACCESS_KEY=", base64("q", 40), 1),
        named("secret_key=", letters("r", 32), 1),
        named("password=", letters("s", 12), 1),
        named("password: ", value, 0),
        named("token=", value, 0),
        named("secret = ", a, 0),
        named("token_count: ", "cast(pmod(id * 7, 5000) AS STRING)", 0),
        named("token ", long, 0),
        named("secret: ", long, 0),
        named("etag: ", f"substring({hexes('l')}, 1, 32)", 0),
    ]
    pick = lambda at: "CASE pmod(id, {n}) {rows} END".format(n=len(kinds), rows=" ".join(f"WHEN {k} THEN {row[at]}" for k, row in enumerate(kinds)))
    use = [k for k in range(len(kinds)) if k not in without and (not only or k in only)]
    path = f"CASE WHEN pmod(xxhash64(id, 'p'), CASE {pick(1)} WHEN 1 THEN 24 ELSE 4 END) = 0 THEN 'src/tests/case' ELSE 'src0' END"
    rows = spark.range(first, first + n, 1, 1).where(F.pmod("id", F.lit(len(kinds))).isin(use)).select(F.expr(f"concat({pick(0)}, ' {{}} ', {b})".replace("{}", "and")).alias("text"), F.expr(path).alias("path"), F.expr(pick(1)).alias("label"))
    found = rows.select(F.expr(f"get({candidate_sql('text', 'path')}, 0)").alias("c"), "label").where("c IS NOT NULL")
    return found.select("label", *[F.expr(sql).cast("double").alias(name) for name, sql in feature_sql("c").items()])


def train(findings: DataFrame, trees: int = 20, depth: int = 6) -> RandomForestClassificationModel:
    """A forest of ``FEATURES`` by ``label``; findings without a label teach nothing."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(findings.where("label IS NOT NULL").select("label", *FEATURES).coalesce(1))
    return RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=7).fit(rows)


def forest_sql(model: RandomForestClassificationModel, f: str) -> str:
    """The forest's probability of label 1 over a struct ``f`` of features."""

    def node(n) -> str:
        if n.subtreeDepth() == 0:
            stats = list(n.impurityStats().stats())
            return f"{stats[1] / max(sum(stats), 1e-12):.6f}D"
        split = n.split()
        return f"IF({f}.{FEATURES[split.featureIndex()]} <= {split.threshold():.12g}D, {node(n.leftChild())}, {node(n.rightChild())})"

    trees = [node(t.rootNode()) for t in model._java_obj.trees()]
    return f"({' + '.join(trees)}) / {len(trees)}D"


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, longer where ``docs`` has a column called so."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def with_findings(docs: DataFrame, model: RandomForestClassificationModel, path: str | None = "source", out: str = "found") -> DataFrame:
    """``docs`` with an array of candidates and their scores as ``out``; empty for null and empty texts. A ``path`` that is no column gives no evidence."""
    path = path if path in docs.columns else None
    f = ", ".join(f"cast({sql} AS DOUBLE) AS {name}" for name, sql in feature_sql("c").items())
    score = _let(f"struct({f})", "f", forest_sql(model, "f"))
    own = f"transform({candidate_sql('`text`', f'`{path}`' if path else 'cast(null AS string)')}, c -> struct(c.place AS place, c.core AS secret, {score} AS score))"
    return docs.withColumn(out, F.expr(f"coalesce({own}, array())"))


def findings(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, path: str | None = "source") -> DataFrame:
    """``doc_id, word, secret_sha256, length, score, is_secret``: a row per candidate, with a digest in place of the string.

    Whole texts are searched, however long. Null and empty texts have no candidate; null doc_ids and repeated rows are searched like others.
    """
    columns = ["doc_id", "text", *([path] if path in docs.columns else [])]
    rows = with_findings(docs.select(*columns), model, path).where("size(found) > 0").select("doc_id", F.explode("found").alias("x"))
    return rows.select(
        "doc_id", F.col("x.place").alias("word"), F.sha2("x.secret", 256).alias("secret_sha256"), F.length("x.secret").alias("length"), F.round("x.score", 6).alias("score"), (F.col("x.score") >= threshold).alias("is_secret")
    )


def redacted(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, path: str | None = "source", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``n_chars`` counted anew; other texts stay as they were.

    Secrets below ``LEAST`` characters are replaced where they stand alone, not inside other words. Null texts, null doc_ids, repeated rows and
    columns of any name stay.
    """
    found, secrets = _unused(docs, "_found", "_secrets")
    rows = with_findings(docs, model, path, found).withColumn(secrets, F.expr(f"transform(filter(`{found}`, x -> x.score >= {threshold}D), x -> x.secret)"))
    alone = f"regexp_replace(t, concat('(?<![{_SET}])\\\\Q', s, '\\\\E(?![{_SET}])'), '{mark}')"
    clean = rows.withColumn("text", F.expr(f"CASE WHEN size(`{secrets}`) = 0 THEN text ELSE aggregate(array_sort(array_distinct(`{secrets}`), (a, b) -> length(b) - length(a)), text, (t, s) -> IF(length(s) < {LEAST}, {alone}, replace(t, s, '{mark}'))) END"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size(secrets) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
