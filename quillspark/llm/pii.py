"""Personal data: e-mail addresses, IP addresses, card and telephone numbers.

Patterns find the base spans. A character-level bidirectional LSTM with CRF transitions (see tagger)
adds spans that the patterns miss, such as telephone numbers without a plus sign. It is trained in numpy, on the driver, from
generated sentences with labelled spans (fixed seed, TRAINING windows), once: the weights are kept in the shared folder. Texts are cut into overlapping
windows of WINDOW characters every STRIDE; a window is decoded if it holds a digit or an @, without which none of the four
kinds can occur. A span of up to STRIDE characters lies whole within some window; of longer ones the model finds those that do. Spans that touch an inner window edge are left to the neighbouring window; the others are
reconciled over the whole text: among overlapping ones a non-overlapping set of greatest score
is kept. Base spans always stay, and an added span must not touch one and must look like its kind.

Positions are code points, ends exclusive. Defined results. Null text is the empty text, without spans. Texts are searched whole,
however long, in time linear in their length (times the logarithm of their number of spans). Repeated rows give repeated results. An empty
table gives an empty result. Other columns are ignored, or kept by `mask`, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from .common import per_worker, read, texts
from .media import file_system
from .tagger import DIGIT, OWN_CLASS, PAD, Tagger, char_classes

KINDS = ("email", "ip", "card", "phone")
WINDOW = 96
STRIDE = 48
TRAINING = 1600
EPOCHS = 8
SEED = 7

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def patterns():
    # possessive and anchored forms: they match what the plain ones match, in linear time
    return per_worker(
        "pii_patterns",
        lambda: {
            "domain": re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
            "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
            "card": re.compile(r"[0-9](?:[ -]?[0-9])+"),
            "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
        },
    )


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches: at each @ the longest run of local characters before it and a domain after it."""
    domain, last, at = patterns()["domain"], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        found = domain.match(text, at + 1) if begin < at else None
        if found:
            last = found.end()
            yield begin, last
        at = text.find("@", max(at + 1, last))


def digits_of(part: str) -> str:
    return "".join(c for c in part if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    found = patterns()
    for m in found["ip"].finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in found["card"].finditer(text):
        if m.end() - m.start() <= 40 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in found["phone"].finditer(text):
        if 9 <= len(digits_of(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def make(kind: str, rng: random.Random) -> str:
    """A value of one kind, in the patterns' form or another."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda a, b: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(a, b)))
    if kind == "email":
        name = rng.choice([w(3, 8), w(3, 7) + "." + w(3, 8), w(2, 6) + "_" + d(2), w(3, 7) + "." + d(2)])
        return name + rng.choice(["@"] * 5 + [" @ "]) + rng.choice([w(3, 8), w(3, 6) + "." + w(3, 7), w(3, 5) + d(1) + "." + w(5, 7)]) + "." + rng.choice(["com", "org", "net", "de", "fr"])
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        head = rng.choice("3456") + d(14)
        number = next(head + c for c in "0123456789" if luhn(head + c))
        return rng.choice(["", "", " ", "-", "."]).join(number[i : i + 4] for i in range(0, 16, 4))
    area, a, b = d(3), d(3), d(4)
    return rng.choice([f"+1 ({area}) {a}-{b}", f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"1-{area}-{a}-{b}", f"00{d(2)} {d(3)} {d(4)} {d(3)}"])


def other(rng: random.Random) -> str:
    """Something with digits that is no personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    caps = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    date = f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    return rng.choice([d(rng.randint(1, 6)), f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(2)}", date, date.replace("-", "/"), f"{d(2)}:{d(2)}", f"password={hexes(18)}", f'token = "{hexes(40)}"', "AKIA" + caps, f"version {d(1)}.", f"${d(2)}.{d(2)}", f"{d(2)}%", f"{d(4)}-{d(4)}", f"{d(1)},{d(3)},{d(3)}", f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", d(20), f"@{hexes(6)}", f"{d(3)}-{d(2)}"])


def training_windows(n: int, seed: int, width: int = WINDOW):
    """Labelled windows: texts and tags (0 outside; for kind i, 1 + 2i at its first character and 2 + 2i after it)."""
    rng = random.Random(seed)
    syllables = "the ing er and on th re ha ti eau oui ère ment que der ung sch über heit ción ado ñas íl ó ä".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    for _ in range(n):
        text, tags = "", []
        skip = rng.randint(0, 12)
        while len(text) < width + skip:
            at = rng.random()
            if at < 0.12:
                kind = rng.randrange(4)
                part = make(KINDS[kind], rng)
                mark = [1 + 2 * kind] + [2 + 2 * kind] * (len(part) - 1)
            else:
                part = other(rng) if at < 0.2 else word()
                mark = [0] * len(part)
            part += rng.choice(["", "", "", ",", ".", ":", ")"]) + rng.choice([" ", " ", " ", " ", "\n"])
            text, tags = text + part, tags + mark + [0] * (len(part) - len(mark))
        yield text[skip : width + skip], tags[skip : width + skip]


def trained_once(spark: SparkSession) -> dict:
    """The weights, fitted once and kept in the shared folder under a name that the parameters and this code decide."""
    import io
    import uuid
    from pathlib import Path

    import numpy as np

    def fetch():
        code = b"".join((Path(__file__).with_name(f"{m}.py")).read_bytes() for m in ("pii", "tagger"))
        folder = f"{shared_dir(spark)}/quillspark-models"
        system, path = file_system(folder)
        name = f"{path}/pii-{hashlib.sha256(code).hexdigest()[:24]}.npz"
        try:
            with system.open_input_file(name) as f:
                return dict(np.load(io.BytesIO(f.read())))
        except FileNotFoundError:
            weights, raw = trained().p, io.BytesIO()
            np.savez(raw, **weights)
            system.create_dir(path, recursive=True)
            part = f"{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(raw.getvalue())
            system.move(part, name)
            return weights

    return per_worker("pii_weights_" + hashlib.sha256(shared_dir(spark).encode()).hexdigest(), fetch)


def trained(n: int = TRAINING, epochs: int = EPOCHS, seed: int = SEED):
    """The model; the same for the same parameters, so a process trains it once."""

    def fit():
        import numpy as np

        windows = list(training_windows(n, seed))
        x, y = np.array([char_classes(t) for t, _ in windows]), np.array([tags for _, tags in windows])
        return Tagger(1 + 2 * len(KINDS), seed=seed).train(x, y, epochs, seed=seed)

    return per_worker(f"pii_model_{n}_{epochs}_{seed}", fit)


def plausible(kind: str, value: str) -> bool:
    n = len(digits_of(value))
    if kind == "email":
        return re.fullmatch(r"[A-Za-z0-9._%+-]{1,64} ?@ ?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", value) is not None
    if kind == "ip":
        return re.fullmatch(r"([0-9]{1,3}\.){3}[0-9]{1,3}", value) is not None
    if kind == "card":
        return 13 <= n <= 19 and re.fullmatch(r"[0-9][0-9 .-]*[0-9]", value) is not None and luhn(digits_of(value))
    groups = len(re.findall(r"[0-9]+", value))
    return 9 <= n <= 15 and groups >= 3 and re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", value) is not None


def best_set(spans: list[tuple[float, str, int, int]]) -> list[tuple[str, int, int]]:
    """Of overlapping scored spans a non-overlapping set of greatest score (weighted interval scheduling)."""
    spans = sorted(spans, key=lambda s: (s[3], s[2], s[1]))
    ends = [s[3] for s in spans]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for i, (score, _, start, _) in enumerate(spans):
        before = bisect_right(ends, start, 0, i)
        taken = best[before][0] + score
        best.append((taken, before, True) if taken > best[i][0] else (best[i][0], i, False))
    out, at = [], len(spans)
    while at:
        _, before, took = best[at]
        if took:
            out.append(spans[at - 1][1:])
        at = before
    return out[::-1]


def windows_of(classes):
    """Starts of the windows that hold a digit or an @."""
    import numpy as np

    marks = np.nonzero((classes == DIGIT) | (classes == 6 + OWN_CLASS.index("@")))[0]
    last = marks // STRIDE
    return np.unique(np.concatenate((last, last[last > 0] - 1))) * STRIDE


def decoded_spans(model, found: list[str]) -> list[list[tuple[float, str, int, int]]]:
    """Scored spans of each text's windows; windows of all texts are decoded together."""
    import numpy as np

    out, jobs = [[] for _ in found], []
    for i, text in enumerate(found):
        classes = char_classes(text)
        jobs += [(i, start, classes[start : start + WINDOW]) for start in windows_of(classes).tolist()]
    for begin in range(0, len(jobs), 256):
        part = jobs[begin : begin + 256]
        x = np.full((len(part), WINDOW), PAD, np.int64)
        for row, (_, _, classes) in enumerate(part):
            x[row, : len(classes)] = classes
        path, emit = model.decode(x)
        for row in np.nonzero(path.any(axis=1))[0]:
            i, start, classes = part[row]
            tags, n, length = path[row].tolist(), len(classes), len(found[i])
            at = 0
            while at < n:
                tag = tags[at]
                if not tag:
                    at += 1
                    continue
                end, inner = at + 1, tag + tag % 2
                while end < n and tags[end] == inner:
                    end += 1
                if (at > 0 or start == 0) and (end < n or start + n == length):
                    gain = float((emit[row, np.arange(at, end), tags[at:end]] - emit[row, at:end, 0]).sum())
                    out[i].append((gain, KINDS[(tag - 1) // 2], start + at, start + end))
                at = end
    return out


def find(model, found: list[str]):
    """For each text its base spans and its spans, both by kind as listed, then start."""
    bases = [base_spans(t) if t and not t.isspace() else [] for t in found]
    order = {k: i for i, k in enumerate(KINDS)}
    for text, base, scored in zip(found, bases, decoded_spans(model, found)):
        taken = disjoint((a, b) for _, a, b in base)
        free = [s for s in scored if s[0] > 0 and plausible(s[1], text[s[2] : s[3]]) and not overlaps(taken, s[2], s[3])]
        yield base, sorted([*base, *best_set(free)], key=lambda s: (order[s[0]], s[1], s[2]))


def disjoint(found) -> tuple[list[int], list[int]]:
    """Starts and ends, ascending, of the stretches that spans (start, end) cover together."""
    starts, ends = [], []
    for a, b in sorted(found):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def overlaps(taken: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether a stretch of taken meets the span: the last that starts before its end is the only one that may."""
    at = bisect_left(taken[0], end)
    return bool(at) and taken[1][at - 1] > start


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every row."""
    return _found(docs, id_col, text_col)


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(trained_once(docs.sparkSession))
    kind = "array<struct<kind:string,start:int,end:int>>"

    def run(batches):
        import pyarrow as pa

        model = loaded(shipped.value)
        arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                both = list(find(model, texts(part.column(1))))
                columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row[i]] for row in both], arrow) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def loaded(weights):
    model = Tagger(1 + 2 * len(KINDS))
    model.p = weights
    return model


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in brackets, as [EMAIL]; length_col, if docs has it, is brought up to date."""
    shipped = docs.sparkSession.sparkContext.broadcast(trained_once(docs.sparkSession))
    names = docs.columns
    at = names.index(text_col)

    def masked(text: str, found) -> str:
        out, last = [], 0
        for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
            if end <= last:
                continue
            out += [text[last:start], f"[{kind.upper()}]"] if start >= last else []
            last = end
        return "".join([*out, text[last:]])

    def run(batches):
        import pyarrow as pa

        model = loaded(shipped.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                found, columns = texts(part.column(at)), list(part.columns)
                new = [masked(t, s) if s else t for t, (_, s) in zip(found, find(model, found))]
                new = [None if old is None else t for t, old in zip(new, part.column(at).to_pylist())]
                columns[at] = pa.array(new, part.column(at).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in names else out


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = spark.sparkContext.broadcast(trained_once(spark))

    def run(batches):
        import pyarrow as pa

        model = loaded(shipped.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                rows = []
                for base, every in find(model, texts(part.column(1))):
                    counts = [sum(s[0] == k for s in base) for k in KINDS]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
                columns = [pa.array(c) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = read(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


QUERIES = {"op5_pii": op5_pii}
SQL: dict[str, str] = {}
