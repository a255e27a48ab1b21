"""Scenario pack for product listings.  Fixed values; order matters."""

# ---- fixed values: scenario patterns, on the lower-cased title ---------------------
# In the last one the alternation splits before the closing words, so any word
# that begins with "amp" matches; results depend on it, so it is kept.

SCENARIO_PATTERNS = (
    (r"\brca\b.*\b(switch|selector|switcher)\b|\b(switch|selector|switcher)\b.*\brca\b", "RCA切换器"),
    (r"\b(3\.5 ?mm|aux)\b.*\b(switch|selector|switcher)\b|\b(switch|selector|switcher)\b.*\b(3\.5 ?mm|aux)\b", "3.5mm音频切换器"),
    (r"\bspeaker\b.*\b(switch|selector|switcher)\b|\b(switch|selector|switcher)\b.*\bspeaker\b", "扬声器切换器"),
    (r"\bheadphone\b.*\b(switch|selector|switcher)\b|\b(switch|selector|switcher)\b.*\bheadphone\b", "耳机切换器"),
    (r"\b(audio|stereo)\b.*\b(selector|switch|switcher)\b", "音频选择器"),
    (r"\b(line|source)\b.*\b(selector|switch|switcher)\b", "线路切换器"),
    (r"\b(splitter)\b", "音频分配器"),
    (r"\b(mixer)\b", "音频混音器"),
    (r"\bamp|amplifier\b.*\b(selector|switch|switcher)\b", "功放切换器"),
)

# ---- fixed values: words of a search keyword and their label ------------------------

KEYWORD_WORDS = (
    (r"rca", "RCA"),
    (r"3\.?5\s*mm|aux", "3.5mm"),
    (r"\baudio\b", "音频"),
    (r"\bstereo\b", "立体声"),
    (r"\bspeaker\b", "扬声器"),
    (r"\bheadphone\b", "耳机"),
    (r"\bswitcher\b|\bswitch\b", "切换器"),
    (r"\bselector\b|\bselect\b", "选择器"),
    (r"\bmixer\b", "混音器"),
    (r"\bsplitter\b", "分配器"),
    (r"\bamp\b|\bamplifier\b", "功放"),
    (r"\bline\b", "线路"),
)
KEYWORD_DEFAULT = "其他音频设备"

# ---- fixed values: review views, in the order they are read ---------------------------

REVIEW_VIEWS = ("top_reviews", "most_recent", "positive_reviews", "critical_reviews")
