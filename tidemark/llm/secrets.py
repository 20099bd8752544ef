"""Secret scan with a random forest that removes false positives, in DataFrame functions only.

Candidates are long runs of key-like characters and dotted web tokens anywhere in a text, and the value after a key
word such as password, of any length and with any symbols. Each one is described by its
length, its transitions between character classes, its coverage by dictionary words, whether it
stands in a path, and the words next to it. A forest trained on labelled findings votes
on every candidate; it is written out as nested CASE expressions, so scoring is one projection over the
scan without any shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import pick, unique_names

# The words before an assigned secret; a value after one of them is a candidate as a whole.
KEY_WORDS = "token|secret|passw(?:or)?d|passwd|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
_KEY = r"[A-Za-z0-9+/_\-]"
# The first letters of the key words come first, so that most places are left after one look.
_ASSIGNED = rf"(?=[tspabcTSPABC])(?i:{KEY_WORDS})[\x22\x27]?\s*[:=：＝]{{1,2}}>?\s*"
_VALUE = r"\S*[^\s,;.\x22\x27)\]}>]"
# What stands before the value, an opening quote, and the value: quoted ones to the closing quote of the line, others to a blank without
# closing punctuation. Then web tokens with all their parts, and runs of at least 16 key characters that no other one adjoins
# and that do not hold a key word with a value.
CANDIDATE = (
    rf"({_ASSIGNED})(?:(\x22)([^\x22\r\n]+)(?=\x22)|(\x27)([^\x27\r\n]+)(?=\x27)|([\x22\x27]?)({_VALUE}))"
    rf"|(?<!{_KEY})(?:(eyJ[A-Za-z0-9_\-]*+(?:\.[A-Za-z0-9_\-]*+){{1,9}}+)"
    rf"|(?={_KEY}{{16}})(?!{_KEY}*?{_ASSIGNED}[\x22\x27]?{_VALUE})({_KEY}{{16,}}+={{0,2}}(?![A-Za-z0-9])))"
)
MARK = "\u0001"
CONTEXT = 40
MASK = "<SECRET>"

# The documented bounds of the training sample and the forest.
LABELLED_PER_CLASS = 10_000
TRAINING_DOCS = 20_000  # expected number of documents, chosen by a hash, whose findings are labelled
TREES, DEPTH, SEED = 20, 6, 7
VOTES = 0.5

# Common words and word parts; what they cover of a candidate speaks for prose.
DICTIONARY = (
    "the and that this with from have not are was for you all any can had her his one our out day get has him how man new now old see two way who "
    "ing tion ment able ness less ous ive ent ant est ere ion ist ish ity ter ver der den die das und ein ich nicht auf mit von sch cht heit keit ung lich "
    "les des que pour dans est sur pas une qui par eau oir eur aux ent ait los las para con una por como pero mente cion dad ado ido ar er "
    "test data file name user home path http www com org net html index page image text example sample value null true false default"
).split()

# What secrets with a fixed shape look like, and what stands before an assigned one.
SHAPES = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^xox[abprs]-|^sk-[A-Za-z0-9]{20,}|^sk_live_|^eyJ[A-Za-z0-9_-]{20,}$|^eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.]|^AIza[0-9A-Za-z_-]{35}$"
NEAR_KEY = rf"(?i)({KEY_WORDS})[\x22\x27]?\s*[:=\uFF1A\uFF1D]{{0,2}}>?\s*[\x22\x27]?$"

# SQL over a candidate's value @v and the text to its left @l and right @r.
FEATURES = {
    "length": "double(length(@v))",
    "transitions": "(length(regexp_replace(regexp_replace(regexp_replace(@v, '[a-z]+', 'a'), '[A-Z]+', 'A'), '[0-9]+', '0')) - 1) / length(@v)",
    "digits": "(length(@v) - length(translate(@v, '0123456789', ''))) / length(@v)",
    "upper": "length(regexp_replace(@v, '[^A-Z]+', '')) / length(@v)",
    "distinct": "double(size(array_distinct(split(lower(@v), '')))) / length(@v)",
    "dictionary": f"1 - length(regexp_replace(lower(@v), '{'|'.join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))}', '')) / length(@v)",
    "vowels": "length(regexp_replace(lower(@v), '[^aeiou]+', '')) / length(@v)",
    "hex_only": "double(@v rlike '^([0-9a-f]+|[0-9A-F]+)$')",
    "in_path": r"double(@l rlike r'(/|://[^ ]*|www[.][^ ]*)$' or @v rlike r'/.*/')",
    "near_key": f"double(@l rlike r'{NEAR_KEY}')",
    "assigned": r"double(@l rlike r'[:=：＝]>?\s*[\x22\x27]?$')",
    "quoted": r"double(@l rlike r'[\x22\x27]$' and @r rlike r'^[\x22\x27]')",
}
AT = {name: f"f{k}" for k, name in enumerate(FEATURES)}


def described(docs: DataFrame, parts: str, out: str) -> DataFrame:
    """Adds `parts` and `out` (both null for a null text).

    parts: context, candidate, context, ... with candidates at the even places (from 1); their lengths add up to
    the text's. out: per candidate its place i, value v and the features f0, f1, ...
    """
    body = ", ".join(f"'f{k}', {sql.replace('@', 'c.')}" for k, sql in enumerate(FEATURES.values()))
    around = (
        f"transform(filter(sequence(1, size(p)), i -> i % 2 = 0), i -> named_struct('i', i, 'v', p[i - 1], "
        f"'l', right(p[i - 2], {CONTEXT}), 'r', left(p[i], {CONTEXT})))"
    )
    # The split is bound to p: however often the parts are used, the pattern runs once per text.
    plain = F.translate(docs["text"], MARK, " ")
    cut = F.split(F.regexp_replace(plain, CANDIDATE, f"$1$2$4$6{MARK}$3$5$7$8$9{MARK}"), MARK)
    bound = unique_names(docs, ["_cut", "_bound", parts, out])
    once = docs.withColumn(bound["_cut"], F.array(cut))
    made = f"transform({bound['_cut']}, p -> named_struct('parts', p, 'found', transform({around}, c -> named_struct('i', c.i, 'v', c.v, {body}))))[0]"
    once = once.withColumn(bound["_bound"], F.expr(made)).drop(bound["_cut"])
    return once.withColumn(parts, F.col(bound["_bound"])["parts"]).withColumn(out, F.col(bound["_bound"])["found"]).drop(bound["_bound"])


def labelled(found: DataFrame) -> DataFrame:
    """Findings with a label, by rules that are sure of themselves; the others stay unlabelled and drop out.

    1: the shape of a known kind of key, or digits right after a word such as token or password. 0: no digit at all, digits alone,
    mostly dictionary words, or part of a path, and no such word before it.
    """
    f = {name: F.col(at) for name, at in AT.items()}
    shaped = F.col("v").rlike(SHAPES)
    sure = shaped | ((f["near_key"] == 1) & (f["digits"] > 0))
    prose = (f["digits"] == 0) | (f["digits"] == 1) | (f["dictionary"] >= 0.5) | (f["in_path"] == 1)
    label = F.when(sure, 1.0).when(prose & (f["near_key"] == 0), 0.0)
    return found.withColumn("label", label).filter(F.col("label").isNotNull())


def _as_sql(lines: list[str], at: int = 0) -> tuple[str, int]:
    # One node of a printed tree: "If (feature i <= t)" ... "Else ...", or "Predict: p".
    line = lines[at].strip()
    if line.startswith("Predict"):
        return line.split()[1], at + 1
    _, _, feature, _, limit = line.rstrip(")").split()
    left, at = _as_sql(lines, at + 1)
    right, at = _as_sql(lines, at + 1)
    return f"CASE WHEN c.f{feature} <= {float(limit)!r}D THEN {left} ELSE {right} END", at


def fit(found: DataFrame, per_class: int = LABELLED_PER_CLASS) -> str:
    """The forest's share of votes (0 to 1) as SQL over a candidate c, from findings with a label.

    Findings: columns v, label and f0, f1, ...; at most `per_class` of each label are used, in the order
    of a hash. Without both labels there is nothing to learn and every candidate near a key word gets 1, others 0.
    """
    names = list(AT.values())
    order = [F.xxhash64("v", *names), F.col("v")]
    sample = (
        found.select("v", "label", *names)
        .withColumn("_place", F.row_number().over(W.partitionBy("label").orderBy(*order)))
        .filter(F.col("_place") <= per_class)
    )
    rows = sorted(sample.select("label", "_place", *names).collect())  # bounded: two labels
    if len({r[0] for r in rows}) < 2:
        return f"double(c.{AT['near_key']})"
    local = found.sparkSession.createDataFrame([(r[0], *map(float, r[2:])) for r in rows], ["label", *names]).coalesce(1)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    model = forest.fit(VectorAssembler(inputCols=names, outputCol="x").transform(local))
    trees = [_as_sql(t.toDebugString.strip().splitlines()[1:])[0] for t in model.trees]
    return f"({' + '.join(f'({t})' for t in trees)}) / {float(len(trees))!r}D"


def train(docs: DataFrame, training_docs: int = TRAINING_DOCS) -> str:
    """The forest trained on the labelled findings of about `training_docs` documents, all if there are no more; a hash of id and text chooses."""
    part = min(1.0, training_docs / max(docs.count(), 1))
    few = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < part * 1_000_000)
    cands = described(pick(few, "text"), "_parts", "_found")
    # Of an inner explode the optimizer takes the size and null check as a filter of its own, with the pattern in it.
    rows = cands.select(F.explode_outer("_found").alias("c")).filter("c is not null")
    return fit(labelled(rows.select("c.*")))


def scanned(docs: DataFrame, forest: str, votes: float = VOTES) -> tuple[DataFrame, dict[str, str]]:
    """Adds the array columns `found` (i, v, score) and `secrets` (start, length, v, score; start from 0); their names."""
    names = unique_names(docs, ["parts", "cands", "found", "secrets"])
    made = described(docs, names["parts"], names["cands"])
    made = made.withColumn(names["found"], F.expr(f"transform({names['cands']}, c -> named_struct('i', c.i, 'v', c.v, 'score', {forest}))"))
    start = f"length(array_join(slice({names['parts']}, 1, s.i - 1), ''))"
    secrets = (
        f"transform(filter({names['found']}, s -> s.score >= {votes}D), "
        f"s -> named_struct('start', {start}, 'length', length(s.v), 'v', s.v, 'score', s.score))"
    )
    return made.withColumn(names["secrets"], F.expr(secrets)), names


def _masked(text: str, secrets: str) -> Column:
    # The text between the secrets, each followed by the mask, then the rest.
    before = (
        f"transform({secrets}, (s, k) -> concat(substring({text}, if(k = 0, 0, {secrets}[k - 1].start + {secrets}[k - 1].length) + 1, "
        f"s.start - if(k = 0, 0, {secrets}[k - 1].start + {secrets}[k - 1].length)), '{MASK}'))"
    )
    rest = f"substring({text}, {secrets}[size({secrets}) - 1].start + {secrets}[size({secrets}) - 1].length + 1)"
    return F.expr(f"if(size({secrets}) > 0, concat(array_join({before}, ''), {rest}), {text})")


def scan(docs: DataFrame, forest: str | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_candidates, n_secrets, spans ("start+length" in characters, joined by spaces), masked text.

    Null texts have no candidates and stay null; empty ones likewise. Repeated rows and ids stay.
    Without a labelled finding of either kind the key words alone decide. Other columns are ignored.
    """
    forest = train(docs) if forest is None else forest
    made, names = scanned(pick(docs, "doc_id", "text"), forest)
    found, secrets = names["found"], names["secrets"]
    spans = F.expr(f"coalesce(array_join(transform({secrets}, s -> concat(s.start, '+', s.length)), ' '), '')")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    sizes = [F.when(F.col(c).isNull(), F.lit(0).cast("bigint")).otherwise(count(c)) for c in (found, secrets)]
    return made.select("doc_id", sizes[0].alias("n_candidates"), sizes[1].alias("n_secrets"), spans.alias("spans"), _masked("text", secrets).alias("masked"))


def redacted(docs: DataFrame, forest: str | None = None) -> DataFrame:
    """`docs` with every secret in `text` replaced by the mask; rows, ids and other columns stay."""
    made, names = scanned(docs, train(docs) if forest is None else forest)
    clean = _masked("text", names["secrets"])
    return made.select(*[clean.alias(c) if c == "text" else docs[c] for c in docs.columns])
