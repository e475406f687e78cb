"""Text functions over tags, templates and answers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: markers of the chat format
LATENT_OPEN, LATENT_CLOSE = "<abs_vis_token>", "</abs_vis_token>"
LATENT = LATENT_OPEN + LATENT_CLOSE
LATENT_PAD = "<abs_vis_token_pad>"
IMAGE = "<|vision_start|><|image_pad|><|vision_end|>"
ASSISTANT = "<|im_start|>assistant"
BOXED_HINT = "\nPut your final answer within \\boxed{}."
INSTRUCTION = (
    " You FIRST think about the reasoning process as an internal monologue and then provide the final answer.\\nRemember: 1. Solve the problem step by step.\\n2. You MUST put the final answer in \\boxed{}."
)
#: Instructions that a judge's copy of a question goes without.
QUESTION_HINTS = ("Put the letter of your choice within \\boxed{}.", "Put your final answer within \\boxed{}.", "Given the answer in a single word and put it within \\boxed{}.")
JUDGE_QUESTION = "Does the predicted answer exactly or semantically match the ground-truth? Reply 'yes' or 'no'."


def replace(x: Column, old: str, new: str) -> Column:
    """All occurrences of a plain string replaced."""
    return F.replace(x, F.lit(old), F.lit(new))


def replace_all(x: Column, pairs: list[tuple[str, str]]) -> Column:
    """Plain replacements, in order."""
    return reduce(lambda acc, p: replace(acc, *p), pairs, x)


def strip(x: Column, chars: str, left: bool = True, right: bool = True) -> Column:
    """Without any of ``chars`` at the ends."""
    escaped = "".join(f"\\x{ord(c):02x}" for c in chars)
    x = F.regexp_replace(x, f"^[{escaped}]+", "") if left else x
    return F.regexp_replace(x, f"[{escaped}]+\\z", "") if right else x


def occurrences(x: Column, part: str) -> Column:
    """Non-overlapping occurrences of a plain string."""
    return ((F.length(x) - F.length(replace(x, part, ""))) / len(part)).cast("int")


def latent_placeholder(x: Column) -> Column:
    """The content of each latent tag, up to the nearest close, becomes a placeholder."""
    return F.regexp_replace(x, f"(?s)({LATENT_OPEN})(.*?)({LATENT_CLOSE})", "$1<latent>$3")


def question_images(x: Column) -> Column:
    """In a question that has placeholders, these replace its image pads."""
    return F.when(x.contains(LATENT), replace_all(x, [(IMAGE, ""), (LATENT, IMAGE)])).otherwise(x)


def by_turn(x: Column, turn) -> Column:
    """The question part with its images set, and ``turn`` on each assistant part."""
    parts = F.split(x, "<\\|im_start\\|>assistant", -1)
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), turn)
    return F.array_join(F.concat(F.array(question_images(parts[0])), rest), ASSISTANT)


def placeholders_to_images(x: Column) -> Column:
    """Assistant placeholders become image pads; a turn that has any loses the image pads it had."""
    return by_turn(x, lambda t: F.when(t.contains(LATENT), replace_all(t, [(IMAGE, ""), (LATENT, IMAGE)])).otherwise(t))


def images_to_latents(x: Column, size: int) -> Column:
    """Assistant image pads become latent tags with ``size`` pads."""
    return by_turn(x, lambda t: replace(t, IMAGE, LATENT_OPEN + LATENT_PAD * size + LATENT_CLOSE))


def latents_after_images(x: Column, size: int) -> Column:
    """Latent tags with ``size`` pads follow assistant image pads."""
    return by_turn(x, lambda t: replace(t, IMAGE, IMAGE + LATENT_OPEN + LATENT_PAD * size + LATENT_CLOSE))


def tighten(x: Column) -> Column:
    """No white space around angle brackets and slashes."""
    return F.regexp_replace(x, "\\s*(<|>|/)\\s*", "$1")


def boxed_format(x: Column) -> Column:
    """1 if there is a boxed answer, else 0."""
    return x.rlike("(?s)\\\\boxed\\{.*?\\}").cast("double")


def uses_latent(x: Column) -> Column:
    """1 if a latent tag opens, else 0."""
    return x.contains(LATENT_OPEN).cast("double")


def think_format(x: Column) -> Column:
    """1 if the whole text is a think part and an answer part, else 0."""
    return x.rlike("(?s)^<think>.*</think>\\s*<answer>.*</answer>\\z").cast("double")


def last_number_before_close(x: Column, compat: bool = False) -> Column:
    """Text after the last "is" up to ``</answer>``; the string None if there is no "is".

    Without a close it goes to the end; with ``compat`` its last character is left out.
    """
    low = F.lower(x)
    back = F.locate("si", F.reverse(low))
    start = F.length(x) - back + 1
    close = F.instr(x, "</answer>") - 1
    end = F.when(close >= 0, close).otherwise(F.length(x) - (1 if compat else 0))
    return F.when(x.isNull(), None).when(back == 0, "None").otherwise(F.substring(x, start + 1, F.greatest(F.lit(0), end - start)))


def without_angles(x: Column, depth: int = 8) -> Column:
    """Without angle-bracket spans, nested up to ``depth``, and trimmed."""
    for _ in range(depth):
        x = F.regexp_replace(x, "<[^<>]*>", "")
    return F.trim(x)


def trim_answer(x: Column) -> Column:
    """Without spaces, line feeds and trailing dots, twice."""
    for _ in range(2):
        x = strip(strip(x, " \n"), ".", left=False)
    return x


#: Symbols dropped or written otherwise before answers are compared.
SYMBOLS = [("\\$", ""), ("$", ""), ("\\%", ""), ("%", ""), ("^\\circ", ""), ("^{\\circ}", ""), ("π", "\\pi"), ("{,}", ""), ("°", "")]


def normalise_symbols(x: Column) -> Column:
    """Symbols replaced, in lower case."""
    return F.lower(replace_all(x, SYMBOLS))


def right_side(x: Column) -> Column:
    """The right side of a single equation, or the left one if the right is 0 and the left has two characters."""
    parts = F.split(x, "=", -1)
    left, right = parts[0], F.get(parts, F.lit(1))
    zero = (trim_answer(right) == "0") & (F.length(trim_answer(left)) >= 2)
    return F.when(F.size(parts) == 2, F.when(zero, left).otherwise(right)).otherwise(x)


def comma_list(x: Column) -> Column:
    """A list with commas in braces, in an array; empty without commas."""
    return F.when(x.contains(","), F.array(F.concat(F.lit("{"), x, F.lit("}")))).otherwise(F.array().cast("array<string>"))


def plain_roots(x: Column) -> Column:
    """Root signs over braces or parentheses as LaTeX."""
    x = F.regexp_replace(x, "√\\{([^{}]*)\\}", "\\\\sqrt{$1}")
    return F.regexp_replace(x, "√\\(([^()]*)\\)", "\\\\sqrt{$1}")


def without_boxed_hint(x: Column) -> Column:
    """A question without its instructions to box the answer, trimmed."""
    return strip(replace_all(x, [(h, "") for h in QUESTION_HINTS]), " \n\t\r")


def last_choice(x: Column) -> Column:
    """The last stand-alone letter A to E in upper case, else the text without its end dot."""
    found = F.regexp_extract_all(F.upper(x), F.lit("\\b(A|B|C|D|E)\\b"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(strip(F.trim(x), ".", left=False))


def triggered_choice(x: Column) -> Column:
    """The first letter after the last "choice is" or "answer is"; the last letter without such words."""
    parts = F.split(x, "choice is|answer is", -1)
    tail = F.element_at(parts, -1)
    found = F.regexp_extract_all(F.upper(tail), F.lit("\\b(A|B|C|D|E)\\b"), F.lit(1))
    pick = F.when(F.size(parts) > 1, F.get(found, F.lit(0))).otherwise(F.get(found, F.size(found) - 1))
    return F.when(F.size(found) > 0, pick).otherwise(strip(strip(F.trim(tail), ".", left=False), "/", left=False))


def only_number(x: Column) -> Column:
    """Digits, dots and minus signs."""
    return F.regexp_replace(x, "[^0-9.\\-]", "")


def grouped_digits(x: Column) -> Column:
    """Runs of more than three digits with commas; leading zeros of such runs go."""
    stripped = F.regexp_replace(x, "(?<![0-9])0+(?=[0-9]{4,})", "")
    return F.regexp_replace(stripped, "(?<=[0-9])(?=(?:[0-9]{3})+(?![0-9]))", ",")


def without_thousands(x: Column) -> Column:
    """Numbers without their thousands commas."""
    return F.regexp_replace(x, "(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")


def steps(x: Column, delimiter: str) -> Column:
    """Parts of a solution by a delimiter, each trimmed and without a leading number and colon."""
    return F.transform(F.split(x, delimiter, -1), lambda s: strip(F.regexp_replace(s, "^ [0-9]+(\\.[0-9]+)?: ", ""), " \n\t\r"))


def all_numbers(x: Column) -> Column:
    """Numbers in order: between dollars, scientific, fraction, decimal, with commas, integer."""
    pattern = r"\$([^$]*)\$|-?[0-9]+e-?[0-9]+|-?[0-9]+/[0-9]+|-?[0-9]*\.[0-9]+|[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?![0-9,])|-?[0-9]+"
    return F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda s: F.regexp_replace(s, r"[$,]", ""))


def intervals(x: Column) -> Column:
    """Interval expressions, joined ones as one."""
    one = r"[\[(][A-Za-z0-9+\-*/^|%$!\\{}]+ ?, ?[A-Za-z0-9+\-*/^|%$!\\{}]+[\])]"
    return F.regexp_extract_all(x, F.lit(one + r"(?: ?\\cup ?" + one + ")*"), F.lit(0))


def shortest_tail(x: Column, splits: list[str]) -> Column:
    """Of the texts after the last occurrence of each split string, the shortest; null if none occurs."""
    tails = F.array_compact(F.array(*(F.when(x.contains(s), F.element_at(F.split(x, "\\Q" + s + "\\E", -1), -1)) for s in splits)))
    return F.get(F.array_sort(tails, lambda a, b: F.length(a) - F.length(b)), F.lit(0))


def render_prompt(question: Column) -> Column:
    """Typed parts of a prompt: text pieces and images in order, empty text left out."""
    full = F.concat(F.trim(question), F.lit(INSTRUCTION))
    parts = F.split(full, "<image>", -1)
    pieces = F.flatten(F.transform(parts, lambda p, i: F.concat(
        F.when(i > 0, F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>")),
        F.when(p != "", F.array(F.struct(F.lit("text").alias("type"), p.alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>")),
    )))
    return pieces


def judge_prompt(question: Column, pred: Column, truth: Column) -> Column:
    """The prompt that asks whether a prediction matches the truth; nulls are empty."""
    said = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("Question: "), said(question), F.lit("\nPredicted Answer: "), said(pred), F.lit("\nGround Truth Answer: "), said(truth), F.lit("\n" + JUDGE_QUESTION))


def choice_prompt(question: Column, options: Column, pred: Column) -> Column:
    """The last part of the prompt that matches an answer with options; the caller puts examples before it."""
    return F.concat(F.lit("Question: "), question, F.lit("?\nOptions: "), options, F.lit("\nAnswer: "), pred, F.lit("\nYour output: "))


def extraction_prompt(examples: Column, question: Column, answer: Column, response: Column) -> Column:
    """The prompt that extracts and judges a response, after its examples."""
    asked = F.concat(F.lit("[Question]: "), question, F.lit("\n[Standard Answer]: "), answer, F.lit("\n[Model Response]: "), response, F.lit("\n[Extracted answer]: "))
    return F.concat(strip(examples, " \n\t\r"), F.lit("\n\n"), asked)


def before_box(text: Column, tokens: Column) -> Column:
    """The tokens before the first box of a text: as many as end before its place, by running lengths, and not the last
    one; null if the text has no box."""
    at = lambda mark: F.locate(mark, text) - 1
    place = F.when(at("\\boxed") >= 0, at("\\boxed")).when(at("\\fbox") >= 0, at("\\fbox"))
    # the place goes along in the state, or the text would be searched again for each token
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), place.alias("place"))

    def add(acc: Column, token: Column) -> Column:
        size = acc["size"] + F.length(token)
        return F.struct(size.alias("size"), (acc["n"] + (size < acc["place"]).cast("int")).alias("n"), acc["place"].alias("place"))

    n = F.aggregate(tokens, start, add, lambda acc: acc["n"])
    return F.when(place.isNotNull(), F.slice(tokens, F.lit(1), F.least(n, F.size(tokens) - 1)))
