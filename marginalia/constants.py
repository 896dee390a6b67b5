"""Word lists, thresholds, texts and formats that results depend on."""

from __future__ import annotations

# --- fixed values: result vocabulary -------------------------------------------------
KINDS = ("doc", "inline", "trailing", "annotation")
ACTIONS = ("keep", "delete", "flag")
SEVERITY_RANK = {"error": 3, "warning": 2, "info": 1}
RULE_DESCRIPTIONS = {
    "wrong-comment": "comment does not describe the code",
    "useless-comment": "comment says nothing the code does not",
    "redundant-annotation": "annotation restates the code",
    "weak-comment": "comment is weak on one axis",
    "wide-scope": "comment is scoped wider than the code it pairs with",
    "low-confidence": "verdict below the confidence threshold",
    "commented-out-code": "comment is disabled code, not prose",
    "fix-aborted": "edits discarded: the file stopped parsing",
}

# --- fixed values: policy ------------------------------------------------------------
# accuracy error, accuracy warning, usefulness delete, usefulness warning,
# minimum confidence, what happens to commented-out code
PROFILES = {
    "strict": (40, 70, 25, 45, 0.4, "delete"),
    "default": (30, 60, 15, 35, 0.5, "ignore"),
    "lenient": (20, 45, 8, 20, 0.65, "ignore"),
}
OVERREACH_GUARD = 0.8
COMMENTED_OUT_GUARD = 0.7
LEVELS = 4

# --- fixed values: defaults ----------------------------------------------------------
LANGUAGES = ("go", "typescript", "javascript", "php", "python")
EXTENSIONS = {
    "go": (".go",),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "php": (".php",),
    "python": (".py", ".pyi"),
}
IGNORE = ("vendor/**", "**/*_test.go", "**/generated/**")
SKIP_DIRS = (".git", "node_modules", ".idea", ".vscode")
EXEMPT_PREFIXES = (
    "TODO", "FIXME", "HACK", "XXX", "Copyright", "SPDX-License-Identifier",
    "@license", "@preserve", "!", "-*-", "vim:", "coding:", "coding=", "nolint",
    "go:", "phpcs:", "@phpstan-", "@psalm-", "{@inheritDoc}", "@inheritDoc",
    "eslint-", "@ts-", "prettier-ignore", "biome-ignore", "oxlint-", "tslint:",
    "jshint", "deno-", "istanbul ", "c8 ", "webpack", "sourceMappingURL",
    "sourceURL", "@jsx", "@flow", "@jest-", "@vitest-", "type: ignore", "noqa",
    "pragma:", "pylint:", "mypy:", "ruff:", "pyright:", "pyre-", "fmt:", "isort:",
    "yapf:", "nosec",
)
MIN_CHARS = 12
CONTEXT_LINES = 20
MAX_CODE_LINES = 40
BINARY_PROBE_BYTES = 8000
CACHE_TTL_DAYS = 90
REQUEST_TIMEOUT_SECONDS = 10
BUDGET_CENTS = 50.0
CONCURRENCY = 8

# --- fixed values: billing -----------------------------------------------------------
USD_PER_INPUT_TOKEN = 0.042 / 1e6
BYTES_PER_TOKEN = 3.6
TOKENS_PER_REQUEST = 250
MAX_REQUEST_TOKENS = 32_000

# --- fixed values: report formats ----------------------------------------------------
JSON_SCHEMA_VERSION = 2
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_VERSION = "2.1.0"
SARIF_LEVELS = {"error": "error", "warning": "warning", "info": "note"}
CHECKSTYLE_VERSION = "8.0"
DIFF_CONTEXT = 3
BAR_WIDTH = 10

# --- fixed values: exit codes --------------------------------------------------------
EXIT_OK, EXIT_FINDINGS, EXIT_TOOL_ERROR, EXIT_BUDGET = 0, 1, 2, 3

# --- fixed values: rubric texts (their byte lengths feed the token estimate) -----------
RUBRIC_TOML = '''
rubric_version = 3

[accuracy]
instructions = """
How accurately does the COMMENT describe the CODE between the >>> CODE and
<<< CODE markers? Use the surrounding CONTEXT only to resolve names and
intent, not as the thing being described.
"""
criteria = [
  "Fundamentally wrong: describes different behavior, values, or intent than the marked code",
  "Materially misleading: partly right but a reader would draw a wrong conclusion",
  "Roughly correct: minor imprecision, nothing a reader would act on wrongly",
  "Accurate without material errors",
]

[usefulness]
instructions = "How much does the COMMENT tell a competent reader that the marked CODE does not already say?"
criteria = [
  "No information beyond the code: restates the code or the signature, or states a type the code already states",
  "Marginal: a hint a reader could derive anyway, e.g. a unit, an expanded abbreviation, a section label",
  "Useful: explains a why, an invariant, an edge case, or a non-obvious effect",
  "Essential context: without it the code would be misread or misused",
]

[overreach]
instructions = "The COMMENT describes behavior or purpose that lies outside the marked CODE, for example the whole function or a later section."

[commented_out]
instructions = """
The COMMENT is source code switched off by commenting it out, rather than text
written for a reader. Prose that quotes code, names identifiers or shows a
usage example is not.
"""
'''

# --- fixed values: legends of the recorded scorer ---------------------------------------
ACCURACY_LEGEND = (
    "Fundamentally wrong",
    "Materially misleading",
    "Roughly correct",
    "Accurate without material errors",
)
USEFULNESS_LEGEND = (
    "No information beyond the code",
    "Marginal",
    "Useful",
    "Essential context",
)
RECORDED_CONFIDENCE = 0.9
