"""Toxicity by weak supervision: many voters, a generative label model over their votes, a linear classifier."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from docquery.llm import linear
from docquery.llm.common import flat_map_rows, map_rows
from docquery.llm.sampling import bounded, labelled

SIZE = 1 << 18  # coordinates: hashed words, then one for each vote, then the bias
MINED_ROWS = 20_000  # most labelled rows that the mined lexicon is drawn from
MINED_WORDS = 500
TRAIN_ROWS = 8_000  # most rows that the classifier is fitted on

# Lexicons of the voters, in lower case.
LEXICONS = {
    "insult": "idiot idiots moron morons loser losers clown clowns scum fool fools jerk jerks imbecile cretin dunce "
              "scumbag lowlife creep coward liar pig swine rat vermin parasite freak weirdo halfwit nitwit simpleton "
              "bigot brute thug wretch dimwit blockhead numbskull".split(),
    "contempt": "trash garbage worthless pathetic disgusting stupid dumb useless ugly filthy hideous repulsive vile "
                "despicable contemptible revolting sickening brainless spineless gutless laughable inferior "
                "subhuman retarded deranged".split(),
    "profanity": "damn damned crap bullshit shit shitty fuck fucking fucker asshole bastard bitch dick prick slut "
                 "whore cunt piss arse bollocks wanker twat motherfucker".split(),
    "threat": "kill murder strangle stab shoot lynch exterminate slaughter".split(),
    "hate": "hate loathe despise detest abhor".split(),
    "french": "imbécile crétin connard connasse salaud salope ordure minable abruti débile merde putain bâtard "
              "enculé raclure crétine pourriture dégueulasse".split(),
    "german": "idiotin trottel arschloch dummkopf vollidiot schwachkopf abschaum scheiße scheisse drecksau "
              "mistkerl hurensohn wichser miststück versager widerlich erbärmlich wertlos".split(),
    "spanish": "imbécil estúpido estúpida basura escoria payaso payasa cabrón puta mierda pendejo gilipollas "
               "maldito asqueroso asquerosa patético inútil tarado".split(),
}
ADDRESS = re.compile(r"\b(?:you|you're|ur|your|tu|t'es|vous|du|ihr|eres|usted)\b(?:\W+\w+){0,4}?\W+(\w+)", re.IGNORECASE)
MARKS = re.compile(r"[!?]{3,}")
WORDS = re.compile(r"\w+")
VOTERS = [*LEXICONS, "mined", "several", "addressed", "shouting", "nothing found"]
PLACES = {name: k for k, name in enumerate(VOTERS)}


class Voters:
    """Votes on a text: 1 toxic, -1 clean, 0 none. ``nothing found`` is the one that votes clean.

    Mined words are less sure than written lexicons: their voter speaks up from the second occurrence on.
    """

    def __init__(self, mined: list[str]):
        self.of: dict[str, set[str]] = {}
        for name, words in (*LEXICONS.items(), ("mined", mined)):
            for word in words:
                self.of.setdefault(word, set()).add(name)

    def __call__(self, text: str, words: dict[str, int]) -> np.ndarray:
        votes = np.zeros(len(VOTERS), np.int8)
        hits = words.keys() & self.of.keys()
        mined = 0
        for word in hits:
            for name in self.of[word]:
                if name == "mined":
                    mined += words[word]
                else:
                    votes[PLACES[name]] = 1
        votes[PLACES["mined"]] = mined > 1
        if not votes.any():
            votes[PLACES["nothing found"]] = -1
            return votes
        if len(hits) > 1:
            votes[PLACES["several"]] = 1
        if any(m[1].lower() in hits for m in ADDRESS.finditer(text)):
            votes[PLACES["addressed"]] = 1
        if MARKS.search(text):
            votes[PLACES["shouting"]] = 1
        return votes


@dataclass
class LabelModel:
    """Accuracies of voters and how strongly pairs of them agree beyond what the label explains."""

    prior: float
    given_toxic: np.ndarray  # voter by vote (clean, none, toxic)
    given_clean: np.ndarray
    weight: np.ndarray  # of a voter: correlated voters share theirs

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = np.arange(votes.shape[1]), votes.astype(int) + 1
        odds = np.log(self.given_toxic[at]) - np.log(self.given_clean[at])
        return 1 / (1 + np.exp(-np.clip(odds @ self.weight + np.log(self.prior / (1 - self.prior)), -35, 35)))

    @classmethod
    def fit(cls, votes: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 50) -> LabelModel:
        """Expectation-maximisation over distinct vote patterns and how many texts have each.

        Starts from the belief that voters are right more often than not. After each round the residual correlation of
        each pair of voters, given the posterior, is estimated, and a voter's weight becomes one over one plus the
        sum of its correlations, so that copies of one signal count once.
        """
        places = votes.astype(int) + 1
        one = np.stack([places == v for v in range(3)], axis=2)  # pattern, voter, vote
        count = votes.shape[1]
        smooth = np.array([[0.2, 1.0, 0.8]]) * np.ones((count, 1))
        model = cls(prior, smooth / 2, smooth[:, ::-1] / 2, np.ones(count))
        for _ in range(rounds):
            toxic = model.posterior(votes)
            tables = []
            for share, start in ((toxic, smooth), (1 - toxic, smooth[:, ::-1])):
                table = np.einsum("p,pvk->vk", share * counts, one) + start
                tables.append(table / table.sum(axis=1, keepdims=True))
            model = cls(model.prior, *tables, cls._weights(votes, counts, toxic))
        return model

    @staticmethod
    def _weights(votes: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        total = np.zeros((votes.shape[1],) * 2)
        for share in (toxic * counts, (1 - toxic) * counts):
            mean = share @ votes / max(share.sum(), 1e-9)
            centred = votes - mean
            total += (centred * share[:, None]).T @ centred
        spread = np.sqrt(np.maximum(np.diag(total), 1e-9))
        related = np.abs(total / np.outer(spread, spread))
        np.fill_diagonal(related, 0)
        related[related < 0.05] = 0
        return 1 / (1 + related.sum(axis=1))


def features(mined: list[str]):
    """Text bytes to (coordinates, values): hashed words as dampened counts of unit length, votes, bias."""
    from zlib import crc32

    voters = Voters(mined)
    first = SIZE - 1 - len(VOTERS)

    def row(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        votes, counts = _votes(voters, data)
        at = np.fromiter((crc32(w.encode()) % first for w in counts), np.int64, len(counts))
        found, place = np.unique(at, return_inverse=True)
        values = np.log1p(np.bincount(place, np.fromiter(counts.values(), float, len(counts)), len(found)))
        norm = np.linalg.norm(values)
        cast = np.flatnonzero(votes)
        return (np.concatenate([found, first + cast, [SIZE - 1]]),
                np.concatenate([values / norm if norm else values, votes[cast], [1.0]]))

    return row


def _votes(voters: Voters, data: bytes):
    from collections import Counter

    text = data.decode("utf-8", "replace")
    counts = Counter(WORDS.findall(text.lower()))
    return voters(text, counts), counts


def mined_words(rows: DataFrame, words: int = MINED_WORDS, odds: float = 8.0, surprise: float = 10.0) -> list[str]:
    """Words of labelled rows (a bounded sample) found ``odds`` times as often in toxic texts as in clean ones.

    The toxic share among a word's texts must also be ``surprise`` natural logarithms unlikely at the overall share
    (five toxic texts and no clean one, where one in eight is toxic). Copies of a text count once.
    """
    rows = rows.where("text IS NOT NULL").dropDuplicates(["text"])
    held = rows.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("word"))
    toxic, clean = F.sum(F.when(F.col("label") == 1, 1).otherwise(0)), F.sum(F.when(F.col("label") == 1, 0).otherwise(1))
    total = rows.agg(toxic.alias("t"), clean.alias("c")).first()
    if not total.t or not total.c:
        return []
    t, c, share = F.col("t"), F.col("c"), total.t / (total.t + total.c)
    part = lambda n, of: F.when(n > 0, n * F.log(n / (t + c) / of)).otherwise(0.0)
    found = (held.where("word <> ''").groupBy("word").agg(toxic.alias("t"), clean.alias("c"))
             .withColumn("odds", (t / total.t) / ((c + 0.5) / total.c))
             .where((F.col("odds") >= odds) & (part(t, share) + part(c, 1 - share) >= surprise)))
    return [r.word for r in found.orderBy(F.desc("t"), "word").limit(words).collect()]


@dataclass
class Model:
    mined: list[str]
    label_model: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, fold: Column, label: str = "toxic") -> Model:
    """Voters with a mined lexicon, the label model over all texts of the fold, the classifier on its posteriors.

    Labels (of at most MINED_ROWS rows of the fold) give the mined lexicon and the share of toxic texts. Votes are
    counted by pattern over every text of the fold, and the distinct patterns come to the driver (a few hundred, at
    most three to the number of voters). The classifier learns the posterior labels of at most TRAIN_ROWS texts.
    Without labels the mined lexicon is empty and the share is five in a hundred.
    """
    known = labelled(docs, labels, label, fold, MINED_ROWS)
    mined = mined_words(known)
    share = known.agg(F.avg(F.col("label").cast("double"))).first()[0]
    prior = float(np.clip(0.05 if share is None else share, 0.001, 0.5))
    own = docs.where(fold).select("doc_id", "text")

    def patterns():
        voters = Voters(mined)
        return lambda text: iter([([_votes(voters, text or b"")[0].tobytes()],)])

    texts = own.select(F.col("text").cast("binary").alias("text"))
    found = flat_map_rows(texts, "votes binary", patterns, ["text"]).groupBy("votes").count().collect()
    if found:
        votes = np.stack([np.frombuffer(r.votes, np.int8) for r in found])
        counts = np.array([r["count"] for r in found], float)
    else:
        votes, counts = np.zeros((1, len(VOTERS)), np.int8), np.zeros(1)
    order = np.lexsort(votes.T)
    model = LabelModel.fit(votes[order], counts[order], prior)
    weights = linear.train(_posteriors(bounded(own, TRAIN_ROWS), mined, model), lambda: features(mined), SIZE)
    return Model(mined, model, weights)


def _posteriors(rows: DataFrame, mined: list[str], model: LabelModel) -> DataFrame:
    def make():
        voters = Voters(mined)

        def row(doc_id, text):
            votes = _votes(voters, (text or "").encode())[0]
            return doc_id, text or "", float(model.posterior(votes[None])[0])

        return row

    return map_rows(rows, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, label double", make)


def score_toxicity(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` plus ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` for every row.

    Whole texts are scored; null and empty texts are texts in which no voter found anything. Repeated rows get equal
    scores; an empty table gives an empty result. Narrow: no shuffle, one broadcast of a fixed number of weights.
    """
    mined = model.mined
    return linear.score(docs, lambda: features(mined), model.weights, columns).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
