"""Readable texts, hashes and templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of events.
EVENT_LABELS = {
    "run_paraphrasing": "패러프레이징 실행",
    "selected_paraphrasing": "패러프레이징 선택",
    "editor_run_paraphrasing": "에디터 실행",
    "editor_selected_paraphrasing": "에디터 선택",
    "pageview_ad_inflow": "광고 유입",
    "tutorial_start": "튜토리얼 시작",
    "open_sidepanel": "사이드패널 열기",
    "tutorial_complete": "튜토리얼 완료",
    "copy_sentence": "문장 복사",
    "preview_paraphrasing": "미리보기",
    "toggle_field": "필드 전환",
    "change_tone": "톤 변경",
    "change_maintenance": "유지 설정",
    "change_language": "언어 변경",
}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def event_label(name: Column) -> Column:
    """Display name of an event, the name itself when there is none."""
    return F.coalesce(F.try_element_at(literal_map(EVENT_LABELS), name), name)


def format_duration(seconds: Column, precision: int = 2) -> Column:
    """'123.00ms', '1m 5.50s', '1h 1m 1s', '2d 3h'; negative durations read '0s'."""
    whole = lambda c: F.floor(c).cast("string")
    fixed = lambda c: F.format_string(f"%.{precision}f", c.cast("double"))
    hours = F.floor(seconds / 3600)
    minutes = F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    return (
        F.when(seconds < 0, "0s")
        .when(seconds < 1, F.concat(fixed(seconds * 1000), F.lit("ms")))
        .when(seconds < 60, F.concat(fixed(seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(whole(seconds / 60), F.lit("m "), fixed(F.pmod(seconds, F.lit(60))), F.lit("s")))
        .when(
            seconds < 86_400,
            F.concat(
                whole(hours), F.lit("h "), whole(minutes), F.lit("m "), F.bround(F.pmod(seconds, F.lit(60)), 0).cast("int").cast("string"), F.lit("s")
            ),
        )
        .otherwise(F.concat(whole(seconds / 86_400), F.lit("d "), whole(F.pmod(seconds, F.lit(86_400)) / 3600), F.lit("h")))
    )


# Fixed values: (upper bound in seconds, unit length, unit name); the last bound is open.
RELATIVE_UNITS = [
    (3600, 60, "minute"),
    (86_400, 3600, "hour"),
    (2_592_000, 86_400, "day"),
    (31_536_000, 2_592_000, "month"),
    (None, 31_536_000, "year"),
]


def relative_time(elapsed: Column) -> Column:
    """'2 hours ago' for positive elapsed seconds, '3 days from now' for negative ones."""
    size = F.abs(elapsed)
    suffix = F.when(elapsed < 0, " from now").otherwise(" ago")

    def phrase(length: int, unit: str) -> Column:
        n = F.floor(size / length)
        return F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"), suffix)

    out = F.when(elapsed.isNull(), "unknown time").when(size < 60, F.concat(F.floor(size).cast("string"), F.lit(" seconds"), suffix))
    for bound, length, unit in RELATIVE_UNITS:
        out = out.otherwise(phrase(length, unit)) if bound is None else out.when(size < bound, phrase(length, unit))
    return out


def context_hash(context: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a struct's JSON; list fields in name order for a stable key."""
    return F.substring(F.sha2(F.to_json(context), 256), 1, 16)


def score_band_reason(score: Column, category: Column) -> Column:
    """Wording of a recommendation by the height of its score."""
    return (
        F.when(score >= 0.8, "Highly relevant to your preferences")
        .when(score >= 0.6, "Matches your usage patterns")
        .when(score >= 0.4, F.concat(F.lit("Popular in "), F.coalesce(category, F.lit("None"))))
        .otherwise("You might like this")
    )


def sources_reason(user_cf: bool = True, item_cf: bool = True, moment: Column | None = None, recency: bool = True) -> Column:
    """Lists the score sources in use."""
    parts = [F.lit("similar users")] if user_cf else []
    parts += [F.lit("your preferences")] if item_cf else []
    parts += [F.concat(F.lit("good for "), moment)] if moment is not None else []
    parts += [F.lit("trending")] if recency else []
    if not parts:
        return F.lit("Recommended for you")
    return F.concat(F.lit("Recommended based on: "), F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ", "))


# Wording per language. Dawn uses the texts meant for the early morning.
TEMPORAL_TEXTS = {
    "ko": {
        "peak": "지금이 가장 활동적인 시간",
        "recent": "최근 관심 보인 항목",
        "dawn": "이른 새벽, 고요한 시간과 어울려요",
        "morning": "상쾌한 아침에 어울리는 선택",
        "afternoon": "여유로운 오후 시간에 딱",
        "evening": "편안한 저녁 시간에 좋아요",
        "night": "조용한 밤에 집중하기 좋아요",
    },
    "en": {
        "peak": "This is your most active time",
        "recent": "Recently caught your interest",
        "dawn": "Fits the stillness of early dawn",
        "morning": "Perfect for a fresh morning",
        "afternoon": "Great for a relaxed afternoon",
        "evening": "Ideal for a calm evening",
        "night": "Suited for a quiet night",
    },
}
AMBIENT_TEXTS = {
    "ko": {
        "category": "‘%s’의 감성을 담은 이야기예요.",
        "dawn": "이른 새벽, 고요한 시간과 어울리는 콘텐츠예요",
        "morning": "맑은 아침에 살짝 기운을 북돋아주는 콘텐츠예요",
        "afternoon": "차분한 오후에 가볍게 즐기기 좋은 추천이에요",
        "evening": "편안한 저녁에 마음을 부드럽게 감싸줄 거예요",
        "night": "조용한 밤, 집중이나 휴식에 잘 어울려요",
        "desktop": "넓은 화면에서 여유롭게 감상할 수 있어요",
        "mac": "Mac 환경에서 섬세하게 즐길 수 있어요",
        "tablet": "편안한 터치 환경에 잘 맞아요",
        "popular": "많은 이들이 살짝 들러본 인기 있는 이야기예요",
        "history": "이전에 관심을 가졌던 분위기와 닮아 있어요",
    },
    "en": {
        "category": "A story reflecting the mood of '%s'.",
        "dawn": "Blends into the calm of early dawn",
        "morning": "Light and uplifting for a clear morning",
        "afternoon": "Gentle companion for a calm afternoon",
        "evening": "Softly unwinds your evening",
        "night": "Quiet night, suited for focus or relaxation",
        "desktop": "Enjoy comfortably on a wide desktop view",
        "mac": "Crafted for a detailed Mac experience",
        "tablet": "Perfect for a relaxed touch on tablet",
        "popular": "A lightly popular choice among readers",
        "history": "Feels familiar — akin to stories you've liked before",
    },
}


def temporal_reason(peak_distance: Column, time_of_day: Column, recent: Column, lang: str = "en") -> Column:
    t = TEMPORAL_TEXTS[lang]
    words = {k: v for k, v in t.items() if k not in ("peak", "recent")}
    return F.concat_ws(
        " • ",
        F.when(peak_distance <= 1, t["peak"]),
        F.try_element_at(literal_map(words), time_of_day),
        F.when(recent, t["recent"]),
    )


def ambient_reason(
    category: Column, time_of_day: Column, device: Column, popularity: Column, uses: Column, lang: str = "en"
) -> Column:
    t = AMBIENT_TEXTS[lang]
    words = literal_map(t)
    known = F.when(device.isin("desktop", "mac", "tablet"), device)
    return F.concat_ws(
        " ",
        F.when(category.isNotNull(), F.format_string(t["category"], category)),
        F.try_element_at(words, time_of_day),
        F.try_element_at(words, known),
        F.when(popularity > 0.7, t["popular"]),
        F.when(uses > 0, t["history"]),
    )


# Suggestion texts per type and the types of the first three ranks.
SUGGESTIONS = {
    "paraphrase": [
        "이 문장을 더 간결하고 명확하게 표현해보세요.",
        "핵심만 남기고 불필요한 부분을 제거해보세요.",
        "같은 의미를 더 짧은 문장으로 바꿔보세요.",
        "문장 구조를 단순화해서 읽기 쉽게 만들어보세요.",
        "중복된 표현을 정리하고 간결하게 다듬어보세요.",
    ],
    "tone": [
        "좀 더 부드럽고 친근한 톤으로 바꿔보세요.",
        "격식 있고 전문적인 느낌으로 수정해보세요.",
        "독자와의 거리를 좁히는 따뜻한 표현으로 바꿔보세요.",
        "공식적이고 신뢰감 있는 어조로 작성해보세요.",
        "좀 더 열정적이고 생동감 있는 톤으로 표현해보세요.",
    ],
    "expand": [
        "이 부분을 구체적인 예시와 함께 확장해보세요.",
        "좀 더 자세한 설명을 추가해서 풍부하게 만들어보세요.",
        "배경 정보나 맥락을 추가해서 완성도를 높여보세요.",
        "독자의 이해를 돕는 추가 설명을 넣어보세요.",
        "관련된 세부 사항을 더해서 깊이 있게 작성해보세요.",
    ],
}


def suggestion_type(rank: Column, score: Column, *seed: Column) -> Column:
    """Types rotate over the first three ranks; later ones are drawn by score band.

    The draw is a hash of `seed`, so a rerun or a lost executor gives the same type.
    """
    draw = F.pmod(F.xxhash64(*seed), F.lit(1_000_000)) / F.lit(1_000_000.0)
    # Cumulative shares of paraphrase and tone per score band.
    first = F.when(score >= 0.8, 0.5).when(score >= 0.5, 0.3).otherwise(0.2)
    second = F.when(score >= 0.8, 0.8).when(score >= 0.5, 0.7).otherwise(0.5)
    drawn = F.when(draw < first, "paraphrase").when(draw < second, "tone").otherwise("expand")
    return F.when(rank == 1, "paraphrase").when(rank == 2, "tone").when(rank == 3, "expand").otherwise(drawn)


def suggestion_text(kind: Column, item_id: Column) -> Column:
    """A text of the type, always the same one for an item."""
    slot = (F.pmod(F.xxhash64(item_id), F.lit(5)) + 1).cast("int")
    out = None
    for name, texts in SUGGESTIONS.items():
        pick = F.element_at(F.array(*[F.lit(t) for t in texts]), slot)
        out = F.when(kind == name, pick) if out is None else out.when(kind == name, pick)
    return out
