"""Topic pack for forum threads.  Fixed values; order matters."""

# ---- fixed values: topic labels ------------------------------------------------

TOPIC_RULES = (
    ("analog_switcher", ("switcher", "a-b-switch", "switching-box", "switch-box", "speaker-switch", "selector")),
    ("digital_switcher", ("toslink", "optical", "spdif", "aes-ebu", "hdmi-3x1", "auto-input-switching")),
    ("switching_preamp", ("preamp", "2-preamps", "schiit-sys", "passive-preamp")),
    ("avr_switching", ("avr", "av-amplifier-and-active-crossover", "soundcard-avr-as-preamp")),
    ("audio_hub", ("audio-hub", "source-control-hub", "all-in-one-device", "multiple-sources", "setup-confusion", "bp50")),
)
TOPIC_DEFAULT = "unclassified"
TOPIC_THEMES = {
    "analog_switcher": "模拟切换器", "digital_switcher": "数字切换器", "switching_preamp": "切换前级",
    "avr_switching": "AVR切换功能", "audio_hub": "家庭音频中枢",
}
THEME_DEFAULT = "待判断"

# ---- fixed values: lines and images that are page furniture -----------------------

IMAGE_URL_FURNITURE = (
    "/data/avatars/", "forum%20resources", "cdn.jsdelivr.net/joypixels", "/reactions",
    "product_images/fav.png", "/favicon", "favicon.",
)
# captions of buttons and logos; add the caption of the forum's own logo
IMAGE_CAPTION_FURNITURE = ("like",)
BADGE_LINES = ("OP", "I", "D", "M", "F", "C", "A", "H", "P", "S", "R", "W", "B", "J", "T")
END_OF_POSTS = (
    "\n[You must log in or register to reply here.]", "\n### Similar threads", "\n## Similar threads",
)

# ---- fixed values: output columns ----------------------------------------------------

POST_COLUMNS = (
    "post_uid", "primary_theme", "secondary_themes", "topic_labels", "product_name", "thread_title",
    "thread_url", "post_no", "author", "author_role", "post_date", "is_thread_starter", "quote_text",
    "post_text", "中文翻译", "raw_text", "image_count", "image_urls", "评论图片预览", "local_file",
    "一级标签", "二级标签", "三级标签", "情绪倾向", "备注",
)
