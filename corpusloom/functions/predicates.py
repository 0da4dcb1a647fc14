"""Row filters: is a string meant to be read by people? Ordered rules, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import has_letter, strip

# Single words that are interface labels.
INTERFACE_WORDS = (
    "play", "start", "quit", "exit", "back", "next", "menu", "save",
    "load", "options", "settings", "continue", "resume", "credits",
    "yes", "no", "ok", "cancel", "confirm", "close", "help", "return",
    "pause", "inventory", "map", "journal", "quest", "tutorial",
    "volume", "audio", "graphics", "controls", "language", "new",
    "delete", "accept", "apply", "reset", "buy", "sell", "equip",
    "use", "drop", "craft", "upgrade", "unlock", "replay", "restart",
    "achievements", "leaderboard", "profile", "skip", "score", "level",
    "fullscreen", "windowed", "easy", "normal", "hard", "extreme",
    "collectibles", "tips", "tutorials",
)
# Single words that are code.
CODE_WORDS = (
    "false", "true", "null", "none", "void", "string", "integer", "boolean",
    "float", "double", "int", "char", "byte",
    "object", "component", "gameobject", "transform",
    "update", "awake", "fixedupdate", "lateupdate",
    "enable", "disable", "active", "enabled", "disabled",
    "manager", "controller", "handler", "provider", "factory", "service",
    "event", "action", "delegate", "callback", "listener", "observer",
    "default", "override", "virtual", "abstract", "static",
    "public", "private", "protected", "internal", "readonly",
    "linear", "easing", "bounce", "elastic",
    "discord", "steam", "firebase", "analytics",
    "debug", "error", "warning", "exception", "log",
    "shader", "material", "texture", "renderer", "collider",
    "rigidbody", "animator", "audiosource", "canvas",
)
# Shapes that are never text.
NEVER = (
    r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$",
    r"^v?[0-9]+(\.[0-9]+){2,}([.\-+][\p{L}\p{N}_]+)?$",
    r"^[0-9a-fA-F]{12,}$",
    r"https?://|www\.",
    r"[/\\]",
    r"(?i)\.(png|jpg|jpeg|gif|bmp|tga|wav|mp3|ogg|mp4|avi|prefab|unity|asset|shader|mat|anim|controller|cs|dll|exe|json|xml|yaml|csv|meta)$",
    r"^[\s{}0-9,:|%\-]+$",
    r"(?i)^\[(DEBUG|INFO|WARNING|ERROR|WARN|FATAL|VERBOSE|TRACE)\]",
)
# Shapes of one word that are identifiers.
IDENTIFIER = (
    r"^[a-z][a-z0-9]*$",
    r"^_+[\p{L}\p{N}_]+$",
    r"^[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+$",
    r"^[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+$",
    r"^[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)+$",
    r"^[A-Z0-9]{2,}(?:_[A-Z0-9]+)+$",
    r"^(?:[\p{L}\p{N}_]+_)+[\p{L}\p{N}_]+$",
)
# File endings of assets, and quoted keys that are never shown.
ASSET_ENDINGS = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".ttf", ".otf", ".ttc", ".ogg", ".mp3", ".wav", ".opus", ".flac", ".webm", ".avi", ".mkv", ".mov", ".rpy", ".rpyc")
STYLE_KEYS = ("window_background", "window_bottom_padding", "window_top_padding", "navigation", "subtitle", "bottom_left", "bottom_right", "top_left", "top_right", "thought", "medium", "small", "large")
PATH_ENDINGS = ("png", "jpg", "jpeg", "tga", "wav", "mp3", "ogg", "prefab", "asset", "json", "xml", "txt", "dll", "cs", "shader", "cginc", "unity", "fbx", "mat")
# Markers of error messages, tested in this order.
RATE_MARKERS = ("429", "too many", "rate limit", "rate-limit", "resource exhausted", "resource_exhausted", "quota", "503", "overloaded", "unavailable", "try again", "temporarily", "capacity", "server is busy", "busy", "provider returned error", "no available provider")
AUTH_MARKERS = ("401", "403", "api key not valid", "invalid api key", "invalid_api_key", "api_key_invalid", "permission", "unauthor", "expired", "billing", "no gemini api key", "no openrouter", "credentials")
CONNECTION_MARKERS = ("failed to connect", "connection", "не удалось подключиться", "connect timeout", "connecterror", "name or service not known", "getaddrinfo", "dns", "ssl", "max retries exceeded", "terminated without result")


def _any_match(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def _any_in(c: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | c.contains(m)
    return out


def game_text(c: Column) -> Column:
    """Labels and sentences, by shape and word lists."""
    t = strip(c)
    low = F.lower(t)
    return (
        F.when((F.length(t) < 2) | ~has_letter(t) | _any_match(t, NEVER), False)
        .when(t.contains(" ") | t.contains("\n") | low.isin(*INTERFACE_WORDS), True)
        .when(_any_match(t, IDENTIFIER) | low.isin(*CODE_WORDS), False)
        .when((F.upper(t) == t) & (F.length(t) <= 20) & ~t.contains("_"), True)
        .otherwise(t.rlike(r"^\p{Lu}[^\p{Lu}]+$") & F.length(t).between(4, 30))
    )


def script_technical(c: Column) -> Column:
    """Asset paths, colours, style keys and markup without letters."""
    t = strip(c)
    bare = F.regexp_replace(F.regexp_replace(t, r"\{[^}]*\}", ""), r"\[[^\]]*\]", "")
    ending = F.lit(False)
    for e in ASSET_ENDINGS:
        ending = ending | F.lower(t).endswith(e)
    path = ~bare.contains(" ") & (bare.contains("/") | bare.contains("\\")) & bare.contains(".")
    return (t == "") | ending | path | t.rlike("^#[0-9a-fA-F]{3,8}$") | t.isin(*STYLE_KEYS) | ~has_letter(bare)


def code_technical(c: Column) -> Column:
    """Blank, without letters, a path to a known file type, or an identifier with underscores."""
    last = F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    path = (c.contains("/") | c.contains("\\")) & last.contains(".") & F.lower(F.element_at(F.split(last, r"\."), -1)).isin(*PATH_ENDINGS)
    return (strip(c) == "") | ~has_letter(c) | path | (~c.contains(" ") & c.contains("_"))


def definition_text(c: Column) -> Column:
    """Values of definitions that aren't booleans, numbers, grammar rules or single symbols."""
    # Booleans, the mark of a rule, shapes of numbers and symbols.
    t = strip(c)
    return ~((t == "") | F.lower(t).isin("true", "false") | t.rlike(r"^-?[0-9]+(\.[0-9]+)?$") | t.contains("->") | t.rlike(r"^\[[^\]]+\]$") | t.rlike(r"^\([^)]*\)$"))


def localised_text(c: Column) -> Column:
    """Has a letter and is not one bracketed constant."""
    t = strip(c)
    return has_letter(t) & ~t.rlike(r"^[\{\[\(][A-Z0-9_\-\s]+[\}\]\)]$")


def setting_text(key: Column, value: Column) -> Column:
    """Key-value pairs whose value is shown."""
    # Keys and values that are settings, the shape of an object reference.
    return ~(F.lower(strip(key)).isin("langid", "sublangid", "language") | F.lower(strip(value)).isin("true", "false", "none") | value.rlike(r"^\([^)]*(Name|Class)=") | ~has_letter(value))


def error_class(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.when(_any_in(m, RATE_MARKERS), "rate").when(_any_in(m, AUTH_MARKERS), "auth").otherwise("other")


def reached_server(message: Column) -> Column:
    return ~_any_in(F.lower(F.coalesce(message, F.lit(""))), CONNECTION_MARKERS)
