"""Configuration and fixed values.

Everything here is small and bounded (a handful of templates, models, thresholds, words); operators turn it into
literal column expressions, so no configuration table ever needs a join.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------------------------------------------
# These must equal the studied programs for right results.
# --------------------------------------------------------------------------------------------------------------

# Prompt templates, one tuple of literal pieces per dataset, in the order they are concatenated around the inputs.
TEMPLATE_BOOLQ = (
    "Read the passage and answer the question with True or False.",
    "\nquestion: ",
    "\npassage: ",
    "\nAnswer: ",
)
TEMPLATE_MNLI = (
    "Select the stance of the premise towards the hypothesis: Entailment (0), Neutral (1), Contradiction (2)",
    "\nPremise: ",
    "\nHypothesis: ",
    "\n Answer: ",
)
TEMPLATE_CNN = (
    "Summarize the following news article in about 50 words:",
    "\nInput: ",
    "\nOutput: ",
)
TEMPLATE_SAMSUM = (
    "Summarize the given dialogue. Keep the summary short.",
    "\ndialogue: ",
    "\nsummary: ",
)

# Answer -> label word lists (substring tests on lower-cased text, earlier rules win).
BOOLQ_POSITIVE = ("true", "yes")
MNLI_NEUTRAL = ("1", "neutral")
MNLI_CONTRADICTION = ("2", "contradict", "contradiction")
QNLI_NOT_ENTAIL = ("not entail", "not entailment", "not entailed", "does not entail")
WNLI_ZERO = ("0", "not entail")
COLA_ZERO = ("0", "not accept")
SST2_ONE = ("1", "positive")
MRPC_ZERO = ("0",)
COPA_ZERO = ("0", "choice1")
VAX_GOLD_LABELS = ("ProVax", "AntiVax", "Neutral")
VAX_PRED_LABELS = ("pro-vaccine", "anti-vaccine", "neutral")
VAX_NULL_GOLD = "All"
CAVES_LABELS = (
    "unnecessary", "mandatory", "pharma", "conspiracy", "political", "country",
    "rushed", "ingredients", "side-effect", "ineffective", "religious", "none",
)
HATEX_GOLD_LABELS = ("hatespeech", "offensive", "normal")
HATEX_PRED_LABELS = (("hate speech", "hatespeech"), ("offensive",), ("normal",))
HATEX_PREFIX_CHARS = 15
BOOLQ_KEEP_WORDS = 5          # non-flan answers: keep the first 5 words after cleaning
MNLI_KEEP_WORDS_PHI_SMALL = 10  # the evaluator keeps 10 words for one model only
MNLI_PHI_SMALL = "Phi-3-small-8k-instruct"
NON_ECHO_MARKER = "flan"      # models whose name holds this do not echo the prompt

# Thresholds swept by the grid mains (boolq 8, samsum 6, mnli 2).
THRESHOLDS_BOOLQ = (0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
THRESHOLDS_SAMSUM = (0.60, 0.65, 0.70, 0.75, 0.80, 0.85)
THRESHOLDS_MNLI = (0.90, 0.95)

# Batch sizes (boolq and samsum cascades 4, mnli and the plain runner 16).
BATCH_SIZE_CASCADE = 4
BATCH_SIZE_DEFAULT = 16
SCORER_LABEL_MIN_F1 = 0.8    # text tasks: scorer label is 1 when the embedding-match F1 is above this

# Share of the training rows held out for validation, in percent.
VALIDATION_PCT = {"boolq": 20, "samsum": 20, "mnli": 60}

# Strategy grids: (name, learning rate, epochs, layout, training text, scorer base). Layout: one scorer per model of
# the chain, or one pooled over them. Training text: the stripped answer, or the original model output.
STRATEGY_GRID = (
    ("strategy-1", 1e-05, 10, "per-model", "stripped", None),
    ("strategy-2", 2e-05, 10, "per-model", "stripped", None),
    ("strategy-3", 4e-05, 10, "per-model", "stripped", None),
    ("strategy-4", 4e-04, 10, "per-model", "stripped", None),
    ("strategy-5", 2e-05, 10, "per-model", "original", None),
    ("strategy-6", 4e-05, 10, "per-model", "original", None),
    ("single-scorer-strategy-2", 1e-05, 10, "pooled", "stripped", None),
    ("single-scorer-strategy-3", 2e-05, 10, "pooled", "stripped", None),
    ("single-scorer-strategy-4", 4e-05, 10, "pooled", "stripped", None),
    ("single-scorer-strategy-5", 2e-05, 10, "pooled", "original", None),
    ("single-scorer-strategy-6", 4e-05, 10, "pooled", "original", None),
)
STRATEGY_GRID_SAMSUM = (
    ("strategy-1", 4e-05, 8, "per-model", "original", "bigbird-roberta-base"),
    ("strategy-2", 8e-05, 8, "per-model", "original", "bigbird-roberta-base"),
    ("strategy-3", 4e-05, 8, "per-model", "original", "longformer-base-4096"),
    ("strategy-4", 8e-05, 8, "per-model", "original", "longformer-base-4096"),
)
STRATEGY_GRID_MNLI = (
    ("strategy_2", 1e-05, 10, "per-model", "stripped", None),
    ("strategy_3", 2e-05, 10, "per-model", "stripped", None),
    ("strategy_4", 5e-05, 10, "per-model", "stripped", None),
    ("strategy_5", 1e-04, 10, "per-model", "stripped", None),
)

# --------------------------------------------------------------------------------------------------------------
# Our own stand-ins (not from the studied programs): model chains with a stub skill per tier.
# --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tier:
    tier: int
    model: str
    skill: int  # stub responder: answer is right when h(prompt, model) < skill (percent)

    @property
    def echoes(self) -> bool:
        return NON_ECHO_MARKER not in self.model


CHAINS: dict[str, tuple[Tier, ...]] = {
    "flan": (Tier(1, "flan-t5-base", 70), Tier(2, "flan-t5-large", 83), Tier(3, "flan-t5-xl", 90)),
    "phi": (
        Tier(1, "Phi-3-mini-4k-instruct", 55),
        Tier(2, "Phi-3-small-8k-instruct", 66),
        Tier(3, "Phi-3-medium-4k-instruct", 77),
    ),
}

# strategy name -> chain name; each strategy has its own scorer, so its own scores.
STRATEGIES: dict[str, str] = {"strategy-1": "flan", "strategy-2": "flan", "strategy-9": "phi"}

# Stub answer phrasings per class; index chosen by a hash so the rules see varied text.
PHRASES_BOOLQ = (
    ("False", "No.", "false - the passage disagrees", "I would say it is not the case"),
    ("True", "Yes.", "true, because the passage says so", "**Yes**, it is"),
)
PHRASES_MNLI = (
    ("Entailment (0)", "entailment", "0", "The premise entails it."),
    ("Neutral (1)", "neutral", "1", "It is neutral."),
    ("Contradiction (2)", "contradiction", "2", "CONTRADICTS the hypothesis"),
)

# Stub answer phrasings for the evaluation tasks (our own stand-ins), per class where the task has classes.
EVAL_CLASS_PHRASES = {
    "boolq": PHRASES_BOOLQ,
    "mnli": PHRASES_MNLI,
    "qnli": (("entailment", "It is entailed."), ("not entailment", "It does not entail that.")),
    "wnli": (("0", "not entailment"), ("1", "entailment")),
    "cola": (("0", "not acceptable"), ("1", "acceptable")),
    "sst2": (("0", "negative"), ("1", "positive")),
    "mrpc": (("0", "not equivalent (0)"), ("1", "equivalent")),
    "copa": (("0", "choice1"), ("1", "choice2")),
}
EVAL_MULTILABEL_PHRASES = {
    "vax": ("pro-vaccine", "Anti-vaccine stance", "neutral", "pro-vaccine and neutral", "unclear"),
    "caves": ("side-effect, pharma", "Rushed and political", "none", "mandatory; conspiracy; country", "ineffective"),
    "hatex": ("Hate speech.", "hatespeech", "This is offensive", "normal", "The text is normal, not hate speech"),
}
VAX_GOLD_CHOICES = ("ProVax", "AntiVax", "Neutral", None)
HATEX_GOLD_CHOICES = HATEX_GOLD_LABELS
STSB_PHRASES = ("4.5", "3/5", "3", "", "4.x", "abc", "2.0 because", "5")
EVAL_MODELS = (CHAINS["flan"][0], CHAINS["flan"][2], CHAINS["phi"][1])
