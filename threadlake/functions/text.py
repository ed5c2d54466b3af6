"""Text expressions of the session model. Patterns under FIXED are values that results depend on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# FIXED values: patterns and replacements.
FENCE = r"(?s)```(\w*)\n?(.*?)```"
ACKNOWLEDGEMENT = r"(?m:^)(?i:sure|great|of course|absolutely|certainly|ok|okay)[!.,]?\s*"
OPENER = r"(?m:^)(?i:i understand|i see|i'll help|let me|i can help)[^.!?]*[.!?]\s*"
NOISE = [r"(?m)^#{1,6}\s+", r"\*{1,2}([^*]+)\*{1,2}", r"_{1,2}([^_]+)_{1,2}", r"(?m)^\s*[-*+]\s+", r"(?m)^\s*\d+\.\s+", r"\n{3,}", r"[ \t]{2,}"]
DANGEROUS = [
    (r"(?is)<script.*?(?:</script>|\z)", "[SCRIPT REMOVED]"),
    (r"(?i)javascript\s*:", "javascript_REMOVED:"),
    (r"(?i)vbscript\s*:", "vbscript_REMOVED:"),
    (r"(?i)data\s*:(?!image/)", "data_REMOVED:"),
    (r"(?i)\bon\w{2,15}\s*=", "onEVENT_REMOVED="),
    (r"(?i)</?(iframe|object|embed|form|input|base|applet|meta|link)\b[^>]*>", "[TAG REMOVED]"),
    (r"(?i)\[\s*SYSTEM\s*\]", "[SYSTEM_TAG_SANITIZED]"),
    (r"(?i)<<<\s*INSTRUCTIONS\s*>>>", "[INSTRUCTIONS_TAG_SANITIZED]"),
]
CREDENTIALS = [r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", r"(?i)Authorization:\s*\S+", r"sk-[A-Za-z0-9]{20,}", r"""(?i)api[_-]?key[\s:=]+["']?[A-Za-z0-9\-._]{16,}["']?"""]
PURE_ACKNOWLEDGEMENT = r"^(?i:(?:sure|of course|absolutely|certainly|got it|understood|okay|ok|alright|happy to help|great|sounds good|will do|no problem|perfect)[!.,]?\s*(?:i['’]?ll|let me|here['’]?s|i can|to)?\s*)[^a-zA-Z]*$"
ERRORS = [
    r"\b(?:Traceback|TypeError|ValueError|ReferenceError|SyntaxError|RuntimeError|AttributeError|NameError|ImportError|KeyError|IndexError|ZeroDivisionError)\b",
    r"\bat\s+\w[\w.]*\s+\([^)]+:\d+:\d+\)",
    r"\bError:\s+\S",
    r"Exception\s+in\s+thread",
]
FLUFF = r"^(?i:(?:can|could|would|will|please|just|basically|actually|i was wondering|sure|of course|i'd like to|i need to|help me|hi|hello|hey)[,\s]+)+"
PROMPT_OPENERS = ["You are a", "Read every file", "TASK —", "REQUIRED"]
MODELS = r"(?i)\b(?:GPT-?[34o]|Haiku|Sonnet|Opus|Llama|Mistral|Gemma|Qwen|Kimi|Copilot)\b"
COMPARISON = r"(?i)\b(?:benchmark|leaderboard|eval(?:uation)?|ranking|compared? to|versus|vs|outperform|scores? higher)\b"
BENCHMARK_NAME = r"(?i)\bSWE[- ]bench\b"
DECISION_SCORES = [
    (r"(?i)\broot cause\b|\bcaused by\b|\bfixed by\b|\bresolved by\b", 3),
    (r"(?i)\bdecided\b|\bchose\b|\bopted for\b|\bwent with\b|\bgoing with\b", 2),
    (r"(?i)\binstead of\b|\brather than\b|\bswitching to\b|\bmigrating to\b", 2),
    (r"`[^`]+`|\b[A-Z][a-zA-Z]+Error\b", 2),
    (r"(?i)\bthis works because\b|\bthe reason\b|\bbecause of\b", 1),
]
BUG_SCORES = [
    (r"(?i)\broot cause\b|\bcaused by\b|\bfixed by\b|\bresolved by\b", 4),
    (r"\b[A-Z][a-zA-Z]+(?:Error|Exception)\b", 3),
    (r"(?i)\brace condition\b|\bnull pointer\b|\bmemory leak\b|\bdeadlock\b", 3),
    (r"(?i)\bworkaround\b|\bhotfix\b|\bpatched\b", 1),
    (r"(?i)\bbreak(?:ing|s)\b|\bfail(?:ing|ed|s)\b", 2),
    (r"(?i)\bfailed to\b|\bnot (?:found|matching|detecting)\b", 2),
    (r"(?i)\bHTTP [45]\d\d\b", 2),
]
STOP_WORDS = """the a an is are was were be been have has had do does did will would could should may might can this that these those which who what
where when how and or but not if then than so as at by for in of on to up from with about i you we they me my""".split()
TROUBLE = r"(?i)error|bug|fix|fail|issue|crash|broken"
LANGUAGES = [
    (r"import React|ReactDOM|jsx|tsx|<\w+\s*/>", "typescript"),
    (r"def\s+\w+\(|from\s+\w+\s+import|print\(", "python"),
    (r"fn\s+\w+|let mut |impl\s+\w+|use std::", "rust"),
    (r"func\s+\w+|package\s+\w+|:=|fmt\.", "go"),
    (r"class\s+\w+|function\s+\w+|const\s+\w+\s*=", "javascript"),
]
NATIVE_IDS = {
    "chatgpt": r"^/c/([a-zA-Z0-9-]+)",
    "claude": r"^/chat/([a-zA-Z0-9-]+)",
    "grok": r"^/(?:chat|conversation)/([a-zA-Z0-9-]+)",
    "gemini": r"^/app/([a-zA-Z0-9-]+)",
    "deepseek": r"^/(?:a/chat/s|chat)/([a-zA-Z0-9-]+)",
}


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def collapsed(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("bigint")


def first_only(text: Column, pattern: str, by: str) -> Column:
    """The first match alone replaced."""
    return F.regexp_replace(text, rf"\A((?s:.*?)){pattern}", f"$1{by}")


def cleaned(text: Column) -> Column:
    """Prose without markdown; every match leaves one space, of the two openers only the first match goes."""
    text = first_only(first_only(text, ACKNOWLEDGEMENT, " "), OPENER, " ")
    return stripped(reduce(lambda t, p: F.regexp_replace(t, p, " "), NOISE, text))


def sanitised(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, *p), DANGEROUS, text)


def scrubbed(text: Column, patterns: list[str] = CREDENTIALS) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, "[CREDENTIAL REDACTED]"), patterns, text)


def xml_text(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_attribute(text: Column) -> Column:
    """Escaped, on one line, 200 characters at most; null gives an empty value."""
    text = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\n", " "), ("\r", " ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.substring(text, 1, 200)


def cdata(text: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(F.coalesce(text, F.lit("")), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def slug(text: Column, length: int = 30) -> Column:
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, length)


def fingerprint(role: Column, content: Column, length: int = 80) -> Column:
    return F.concat(role, F.lit("::"), collapsed(F.substring(content, 1, length)))


def any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def is_acknowledgement(text: Column) -> Column:
    return stripped(text).rlike(PURE_ACKNOWLEDGEMENT)


def has_error(text: Column) -> Column:
    return any_of(text, ERRORS)


def is_prompt(text: Column) -> Column:
    """Opens like an instruction, or is code for more than 40 % of its characters."""
    code = F.length(F.array_join(F.regexp_extract_all(text, F.lit("(?s)(```.*?```)"), 1), ""))
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in PROMPT_OPENERS]) | F.coalesce(code / F.nullif(F.length(text), F.lit(0)) > 0.4, F.lit(False))


def is_meta_discussion(text: Column) -> Column:
    models = F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({MODELS})"), 1), F.lower)))
    return (F.length(text) >= 30) & (((models >= 5) & text.rlike(COMPARISON)) | text.rlike(BENCHMARK_NAME))


def without_fluff(text: Column) -> Column:
    """The first sentence of a request without its polite opening, 150 characters at most."""
    clean = stripped(F.regexp_replace(text, FLUFF, ""))
    sentence = stripped(F.element_at(F.split(clean, r"[.!?\n]"), 1))
    return F.substring(F.when(sentence != "", sentence).otherwise(clean), 1, 150)


def weighed(text: Column, scores: list[tuple[str, int]]) -> Column:
    """Sum of the weights of the patterns found and of the length over 400, up to 1; 10 at most."""
    total = reduce(lambda a, b: a + b, [F.when(text.rlike(p), w).otherwise(0) for p, w in scores])
    return F.least(F.lit(10.0), total + F.least(F.lit(1.0), F.length(text) / 400))


def code_language(code: Column) -> Column:
    return F.coalesce(*(F.when(code.rlike(p), F.lit(name)) for p, name in LANGUAGES), F.lit("unknown"))


def keyword_share(tokens: list[str], content: Column) -> Column:
    """Share of the words of a query, repeats counted, that occur in a text; 0 without words."""
    if not tokens:
        return F.lit(0.0)
    lower = F.lower(content)
    return reduce(lambda a, b: a + b, [F.when(lower.contains(t), 1).otherwise(0) for t in tokens]) / float(len(tokens))


def occurrences(text: Column, token: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("bigint")


def url_key(platform: Column, url: Column) -> Column:
    """platform::host/path, with the parts of the query that tell conversations of a platform apart."""
    host, path, query = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("PATH")), F.try_parse_url(url, F.lit("QUERY"))
    path = F.when(F.coalesce(path, F.lit("")) == "", F.lit("/")).otherwise(path)
    others = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^rid(=|$)")), "&")
    conversation = F.regexp_extract(F.concat(F.lit("&"), query), "&c=([^&]*)", 1)
    kept = (
        F.when(platform == "grok", others)
        .when(platform == "chatgpt", F.when(conversation != "", F.concat(F.lit("c="), conversation)))
        .when(platform.isin("perplexity", "gemini"), F.lit(None).cast("string"))
        .otherwise(query)
    )
    search = F.when(F.coalesce(kept, F.lit("")) != "", F.concat(F.lit("?"), kept)).otherwise("")
    return F.concat(platform, F.lit("::"), F.when(host.isNull(), url).otherwise(F.regexp_replace(F.concat(host, path, search), r"/\z", "")))


def native_id(platform: Column, url: Column) -> Column:
    path = F.try_parse_url(url, F.lit("PATH"))
    found = F.coalesce(*(F.when(platform == p, F.regexp_extract(path, r, 1)) for p, r in NATIVE_IDS.items()))
    return F.when(found != "", found)


def query_variants(task: Column) -> Column:
    """A task and up to four other ways to ask for it by its first six words that mean something, once each."""
    words = F.filter(F.split(F.lower(task), r"\W+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    key = F.array_join(F.slice(words, 1, 6), " ")
    more = F.when((key != "") & (key != F.lower(task)), F.array(key, F.concat(F.lit("implementing "), key))).otherwise(F.array().cast("array<string>"))
    last = F.concat(F.when(task.rlike(TROUBLE), "error debugging ").otherwise("code for "), key)
    return F.slice(F.array_distinct(F.concat(F.array(task), more, F.array(last))), 1, 5)
