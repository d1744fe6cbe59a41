"""Texts that operators return, with places for values in braces."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACE = re.compile(r"\{(\w+)\}")


def _parts(template: str) -> list[tuple[bool, str]]:
    """Pieces in order: literal text (False) and names of places (True)."""
    return [(k % 2 == 1, x) for k, x in enumerate(_PLACE.split(template)) if x]


def fill(template: str, **values: Column) -> Column:
    """The template as a column; null if a value is."""
    pieces = [values[x].cast("string") if place else F.lit(x) for place, x in _parts(template)]
    return F.concat(*pieces)


def fill_sql(template: str, **values: str) -> str:
    """The same as an SQL expression."""
    return "(" + " || ".join(f"CAST({values[x]} AS VARCHAR)" if place else "'" + x.replace("'", "''") + "'" for place, x in _parts(template)) + ")"


# Every text below is part of a result.

RECOMMEND = {
    "topics": "Create dedicated content around your most-discussed topics: {topics}. These drove the most comment volume.",
    "entities": "Consider spotlight videos or segments featuring: {names}. These names appear repeatedly in comments and signal strong audience interest.",
    "themes": "Turn moments around [{themes}] into short-form clips or highlight reels — these themes appear disproportionately in your most-liked comments.",
    "debate": "High reply ratio ({share}) signals debate or discussion. Formats like 'Hot Take', 'Controversial Opinion', or 'Would You Rather' could perform well for this audience.",
    "low_likes": "Average likes per comment is low, suggesting the audience reads but doesn't interact deeply. Test pinned questions or polls to drive more active engagement.",
    "recap": "The variety of discussed topics suggests strong demand for a regular recap or roundup format (weekly/monthly highlights, power rankings, or 'best of' compilations).",
    "clips": "Short-form clip opportunity: extract standalone moments about [{topics}] as YouTube Shorts or Instagram Reels to maximize reach with minimal additional production.",
    "empty": "No comments found — nothing to analyze.",
}
RECOMMEND_MOOD = {
    "cheering_support": "Your audience skews heavily supportive/celebratory. Lean into triumphant moments, comeback narratives, and player-specific fan content to amplify this energy.",
    "surprise_excitement": "Surprise and excitement dominate reactions. Prioritize unexpected moments, shocking shots, and 'I can't believe this happened' style thumbnails and titles.",
    "criticism": "A notable portion of comments express criticism or dissatisfaction. Consider a 'breakdown / reaction' format that acknowledges what went wrong — transparent analysis tends to convert critics into fans.",
    "positive": "Strong positive sentiment overall. Capitalize on this goodwill with series continuations, merch tie-ins, or community challenges.",
}
ANGLES = {
    "topic": "'{topic}' appears to resonate most — use it prominently in video titles, thumbnails, and ad copy.",
    "name": "Name-drop or feature {name} in thumbnails/titles. Fan loyalty around specific people drives click-through.",
    "goodwill": "Audience sentiment is positive — ideal timing to introduce community features (membership, merch, Patreon) without friction.",
    "excitement": "Lead sponsor reads with an 'unbelievable moment' hook — excitement transfers to branded content when placed near peak moments.",
    "copy": "Audience comment language (words, phrases) is a direct source of copy for video descriptions, end screens, and community posts.",
}
SIGNAL_NOTE = "High-liked comment — likely references a notable moment. Review manually to identify the corresponding scene."

NOTE_LIKES = "좋아요 {likes}개 — 공감도 높음."
NOTE_PLAYERS = "{players} 관련 — 해당 선수 등장 장면 확인."
NOTE_STRONG = "감정 강도 높음 — 임팩트 있는 오버레이로 활용 가능."
NOTE_PLAIN = "표준 반응 댓글. 편집자 재량으로 활용."
NOTE_CATEGORY = {
    "dramatic": "극적 반전 반응 — 역전/붕괴 장면과 매칭해 Short 오프닝 카드로 사용.",
    "controversial": "논쟁성 댓글 — 단독 토론형 Short 또는 '시청자 판결' 포맷에 적합. 단독 클립보다 논의 맥락 필요.",
    "analytical": "상세 분석/비판 댓글 — 해당 장면 클립 앞에 자막 카드로 맥락 제공. 브랜드 톤 고려 필요.",
    "funny": "ㅋㅋ 집중 반응 — 실수·어이없는 순간 클립에 오버레이. 텍스트 크게 표시.",
    "critical": "선수 비판 댓글 — 실수 클립과 매칭 가능하나 브랜드 이미지 우선 확인. 단독 Short에는 주의.",
    "clutch_hype": "하이프 반응 — 명장면/굿샷 클립 위에 텍스트 오버레이. 강조 폰트 사용.",
    "emotional": "감정적 반응 — 선수 표정·반응 컷 뒤에 배치. 조용한 BGM과 조합 권장.",
    "supportive": "응원 댓글 — Short 마지막 카드로 마무리. 긍정 에너지 강조.",
    "representative": "일반 반응 댓글 — 요약 섹션이나 중간 카드로 활용. 편집자 재량.",
}

MOMENT_SPAN = "추정 구간: {start}–{end}."
MOMENT_UNSURE = "매칭 신뢰도 낮음 — 수동 구간 확인 필요."
MOMENT_PLAYERS = "등장 선수: {players}."
MOMENT_COUNT = "댓글 {n}개 매칭됨."

# Titles and descriptions of short videos by concept; [선수명] stands for the player named most.
CONCEPT_TITLE = {
    "top_reactions": "댓글이 말했다 — 이 경기의 진짜 주인공",
    "funniest": "ㅋㅋ 모음 — 오늘의 웃음 포인트",
    "dramatic": "끝날 때까지 끝난 게 아니다 — 극적 반전 순간",
    "controversial": "시청자 판결 — 이 장면, 어떻게 생각하세요?",
    "analytical": "시청자가 본 [선수명] — 분석 관전 모음",
    "clutch": "역시 [선수명] — 클러치 순간 모음",
}
CONCEPT_TEXT = {
    "top_reactions": "좋아요 상위 댓글 중심 종합 리캡 Shorts",
    "funniest": "funny 카테고리 상위 댓글 중심 웃음 리캡",
    "dramatic": "dramatic 카테고리 — 역전/붕괴 순간 중심",
    "controversial": "controversial 카테고리 — 논쟁 포인트 중심 토론형 Shorts",
    "analytical": "analytical 카테고리 — 상세 행동/전술 분석 댓글 중심. 클립 앞 자막 카드로 활용.",
    "clutch": "clutch_hype 카테고리 — 좋은 플레이에 대한 하이프 댓글 중심",
}
PLAYER_PLACE = "[선수명]"
NOBODY, OTHER, SCENE = "선수", "상대방", "명장면"
CALL = "여러분의 생각은? 댓글로 남겨주세요 👇"
CLIP_SURE = "타임스탬프 확정 (confidence: {confidence})."
CLIP_UNSURE = "추정 구간 (confidence: {confidence}) — 수동 확인 권장."
CLIP_SPIKE = "스파이크 직접 클립 — 타임스탬프 확정 (high)"
SPIKE_TITLE = "라이브 반응 피크 #{rank} — {time}"
SPIKE_TEXT = "스파이크: {n}개 메시지 · 가중 점수 {weight} · 클립 {time} ({length}s)"
SPIKE_HOOK = "🔥 라이브 반응 급상승!"
SKIP_NO_SEGMENT = "매칭 세그먼트 없음 — 타임스탬프 수동 입력 필요"
SKIP_MANUAL = "일반 댓글: 타임스탬프 없음 (세그먼트: {segment})"
SKIP_UNSURE = "낮은 신뢰도 ({confidence}) — 수동 확인 후 편집"
SKIPPED = "수동 편집 필요: {shown}"
SKIPPED_MORE = " 외 {n}건"
TITLES = [
    "{first} vs {second} — 시청자가 기억하는 진짜 승부",
    "이 경기의 진짜 주인공은? — 댓글이 말하는 풀매치 리뷰",
    "전반의 흐름, 후반의 반전 — {first} 하이라이트 편집본",
    "댓글 {total}개가 선택한 {event} 순간 BEST 모음",
    "보는 내내 이랬음 ㅋㅋ — {first} 풀게임 시청자 반응 총정리",
]
PLAN_NOTE = "이 플랜은 댓글 언어 패턴으로 추론된 것입니다. 서사 순서는 실제 영상 확인 후 편집자가 조정해야 합니다."
PLAN_EMPTY = "댓글 데이터 없음 — 마스터 플랜을 생성할 수 없습니다."

# What a scene is called by who and what is known of it.
SUBJECT_BOTH = "{player}의 {event}"
SUBJECT_PLAYER = "{player} 관련 장면"
SUBJECT_EVENT = "{event} 장면"
PAIR = "{first}·{second}"
CAUSE_BEFORE = "스파이크 직전 해설"
CAUSE_DURING = "스파이크 중 해설"
CAUSE_BOTH = "[{label}] 「{snippet}」\n→ 채팅 기반 보완: {subject}"
CAUSE_SPOKEN = "[{label}] 「{snippet}」"
CAUSE_CHAT = "{subject}  (자막 없음 — 채팅 텍스트 기반 추론)"
CAUSE_NONE = "근거 불충분 — 채팅량만으로 선정된 구간"
REACTION = "{n}개 메시지 / 반응 유형: {profile}"
REACTION_NONE = "{n}개 메시지 (반응 유형 미분류)"
READ_BOTH = "해설 + 채팅 두 신호 일치: {subject} 장면에서 해설자가 해당 상황을 묘사했고, 시청자들은 {reaction}으로 즉각 반응했습니다."
READ_SPOKEN = "해설 맥락이 존재하나 선수/이벤트 특정 불가. 채팅에서는 {reaction} 반응({n}개)이 관측됩니다."
READ_SPOKEN_ONLY = "해설 맥락 존재. 채팅 반응 유형 미분류 — 메시지 수만으로 스파이크 선정."
READ_CHAT = "자막 없음 — 채팅 텍스트만으로 추론: {subject}에서 {reaction} 반응 집중. 실제 인과관계 확인 필요."
READ_NONE = "자막 없음 + 채팅 텍스트 근거 불충분. 메시지 밀집도만으로 스파이크 선정된 구간 — 수동 검토 권장."
SHORT_BOTH = "{subject} → {reaction}"
SHORT_NONE = "반응 구간"

MOODS = {"strong": "강한 탄성과 흥분", "surprised": "놀라움과 감탄", "attentive": "감탄과 집중", "tense": "긴장감"}
BUZZ_LABEL = {"mixed": "이벤트 + 참여자 반응 혼합", "broadcast_event": "방송 이벤트 반응", "participant_driven": "참여자 중심 화제", "general": "일반 반응"}
HEADLINE_SPOKEN, HEADLINE_NONE = "해설 기반 이벤트", "채팅 밀집 구간"
FELT_BOTH = "해설진은 {mood}을 표했고, 시청자들도 {reaction}{ro} 즉각 반응했습니다"
FELT_SPOKEN = "해설진과 시청자 모두 {mood}을 표했습니다"
FELT_CHAT = "시청자들이 {reaction}{ro} 즉각 반응했습니다"
FELT_NONE = "채팅에 반응이 집중됐습니다"
BUZZ_EVENT = {
    "both": "{player}{ga} 인상적인 {event}{eul} 기록하며, {felt}.",
    "player": "{player} 관련 장면에서, {felt}.",
    "event": "{event} 장면에서, {felt}.",
    "none": "방송 이벤트 구간에서, {felt}.",
}
BUZZ_PERSON = {
    "reaction": "{person}{ga} 채팅에 직접 참여하며 시청자들과 소통한 구간으로, 채팅 내 {reaction} 분위기가 형성됐습니다.",
    "none": "{person}의 채팅 참여가 시청자들의 반응을 이끌어낸 구간입니다.",
}
BUZZ_MIXED = {
    "both": "{player}의 {event} 장면과 {person}의 채팅 참여가 겹치며, {felt}.",
    "player": "{player} 관련 방송 장면과 {person}의 채팅 참여가 동시에 맞물려 반응이 집중됐습니다.",
    "none": "방송 이벤트와 {person}의 채팅 참여가 동시에 활성화되며, {felt}.",
}
BUZZ_GENERAL = {
    "reaction": "특정 선수나 이벤트 없이 채팅 밀집도만으로 선정된 구간으로, 주된 반응은 {reaction}입니다.",
    "none": "특정 이벤트나 참여자 없이 채팅 밀집도만으로 선정된 구간입니다.",
}

SENTIMENT_OF = {"웃음·재미": "유머·재미", "웃음·가벼운": "유머·재미", "탄성·놀람": "놀람·흥분", "감탄·대박": "감탄·대박", "응원·격려": "응원·격려", "안타까움·슬픔": "안타까움", "탄식·긴장": "안타까움", "충격·당황": "긴장·충격"}
SENTIMENT_GOOD, SENTIMENT_TENSE, SENTIMENT_MIXED = "긍정적", "긴장감", "복합적"

REASON_FEW = "언급 횟수가 데이터셋 중앙값 이하 (저인지)"
REASON_MUCH = "언급 1건당 반응량({rate})이 평균 이상"
REASON_GOOD = "긍정 반응 비율 {share}%로 높음"
REASON_SPIKES = "핵심 스파이크 구간에 연계 ({ranks})"
REASON_NONE = "복합 지표 기준 상위 선수"
LINKED = " (스파이크 #{rank} 연계)"
SUGGEST = {
    "감탄·대박": "기술·샷 중심 하이라이트 클립{linked} — '이 선수의 이 장면' 단독 포맷 추천",
    "놀람·흥분": "기술·샷 중심 하이라이트 클립{linked} — '이 선수의 이 장면' 단독 포맷 추천",
    "유머·재미": "캐릭터·재미 중심 숏츠{linked} — 팬 친화적 인트로 소재로 활용",
    "응원·격려": "내러티브 성장·팬 스토리텔링{linked} — 팬층 확대 소재로 적합",
    "긍정적": "종합 하이라이트 출연 비중 확대{linked} — 다양한 편집 포맷 테스트",
}
SUGGEST_ELSE = "자연스러운 반응 클립 발굴{linked} — 다양한 포맷으로 테스트 권장"

FOUND_SPOKEN = "스파이크 #{rank} ({time}): 해설 「{snippet}」"
FOUND_SPOKEN_EVENT = " → {event} 장면"
FOUND_EVENT = "스파이크 #{rank} ({time}): {name} 관련 {event} 장면"
FOUND_CHAT = "스파이크 #{rank} ({time}): {name} 관련 채팅 집중 구간"
FOUND_REACTION = "총 {mentions}회 언급 · {clusters}개 시간 클러스터 · 긍정 비율 {share}% · 이벤트당 반응 {rate}건\n주요 반응 유형: {kinds}"
LASTING = "{mentions}회의 언급이 방송 초반부터 종반까지 분산되어 있고, 종반부에도 '{said}' 같은 지속적인 관심 신호가 관측됩니다. 이는 단발성 스파이크가 아닌 팬덤 전환 초기 신호로 해석할 수 있습니다."
SPREAD = "총 {clusters}개의 독립적 언급 클러스터에 걸쳐 반응이 분산되어 있습니다. 한 번 이상 시청자 집단 기억에 등록된 선수로, 추가 노출 시 팬층 전환 가능성이 있는 단계입니다."
FIRST_LOOK = "이번 방송에서 {mentions}회 언급됐으며, 주요 반응 감성은 {sentiment}입니다. 현재는 관심 선수 단계이며, 추가 방송 출연을 통해 팬덤 전환 여부 확인이 권장됩니다."
ACTION_SKILL = "① 기술·샷 하이라이트 숏츠{linked}: 시청자가 '대박·장타·이글' 등 기술 감탄 반응을 보인 장면을 단독 클립으로 편집. '이 선수의 이 샷' 단독 포맷 추천.\n② 선수 소개 카드: 시청자 스스로 '{name}' 이름을 검색할 수 있도록 이름 + 배경(신인왕·출신지 등) 자막 삽입."
ACTION_FOUND = "① 발굴 스토리 숏츠{linked}: 채팅에서 '다크호스·신인왕' 등 발견 내러티브가 형성됐습니다. '숨은 고수를 찾아라' 스타일의 편집 포맷이 유효합니다.\n② 인트로 클립: 첫 등장 시 이름 + 경력 자막을 강조하여 아직 모르는 시청자에게 맥락을 제공하는 편집."
ACTION_CHEER = "① 내러티브 성장 숏츠{linked}: 응원 감성이 지배적입니다. '좋아질 선수' 스토리텔링 포맷으로 팬층 확대에 활용.\n② 팬 리액션 오버레이: 응원 채팅을 화면에 표시하여 커뮤니티 소속감을 자극하는 편집."
ACTION_ELSE = "① 종합 하이라이트 비중 확대{linked}: 다양한 반응 패턴이 관측됩니다. 여러 포맷(숏츠·하이라이트·인트로)을 병행 테스트하여 어느 포맷에서 반응률이 높은지 확인.\n② 이름 노출 빈도 증가: 자막·타이틀에 이름을 의식적으로 포함시켜 검색 유입 가능성을 높임."

ACT_LABELS = {
    "act_1_opening": {"name": "개막", "emoji": "🏌️", "text": "경기 시작 — 선수 소개, 초반 분위기"},
    "act_2_buildup": {"name": "전개", "emoji": "📈", "text": "흐름 형성 — 일진일퇴, 상황 설명"},
    "act_3_turning": {"name": "전환점", "emoji": "⭐", "text": "반전 / 전환점 — 분위기를 바꾼 결정적 순간"},
    "act_4_climax": {"name": "클라이맥스", "emoji": "🔥", "text": "최고조 — 승부처, 압박, 하이라이트 샷"},
    "act_5_closing": {"name": "결말", "emoji": "🏆", "text": "마무리 — 결과, 소감, 팬 반응"},
}
SCRIPT = {
    "title": "# 마스터 하이라이트 편집 브리프",
    "video": "영상",
    "players": "분석 선수",
    "no_players": "자동 감지 안 됨",
    "used": "사용 댓글 수",
    "warning": ["**주의:** 이 플랜은 댓글 언어 패턴으로 추론된 서사 구조입니다.  ", "모든 섹션의 순서는 실제 영상 확인 후 편집자가 조정해야 합니다.  ", "`needs_manual_timestamp_mapping: True` 표시 댓글은 타임코드를 직접 찾아야 합니다."],
    "titles": "## 제목 후보",
    "opening": "## 오프닝 훅",
    "category": "카테고리",
    "score": "우선순위 점수",
    "caption": "캡션",
    "usage": "편집 활용",
    "manual": "⚠",
    "sure": "✓",
    "check": "⚠ 수동 타임코드 확인 필요",
    "checked": "✓ 타임코드 확정",
    "acts": "## 5막 서사 구조",
    "related": "관련 댓글",
    "shares": "카테고리 분포",
    "anchor": "**앵커 댓글 (핵심 반응):**",
    "bridges": "**브리지 댓글 (서사 연결):**",
    "points": "## 서사 전환점",
    "points_head": ["| 중요도 | 카테고리 | 좋아요 | 점수 | 댓글 (앞 70자) | 수동확인 |", "|--------|----------|--------|------|----------------|---------|"],
    "arcs": "## 선수별 서사 아크",
    "arc_n": "관련 댓글 수",
    "arc": "감정 아크",
    "peak": "**피크 순간:**  ",
    "top": "**주요 댓글:**",
    "closing": "## 클로징 노트",
    "events": "## 핵심 이벤트 키워드",
    "notes": "## 주의사항",
    "notes_text": [
        "이 문서는 댓글 패턴 분석으로 자동 생성된 편집 브리프입니다.",
        "**서사 순서(5막 구조)는 추론값입니다.** 실제 영상 확인 후 순서를 조정하세요.",
        "`⚠ 수동확인필요` 댓글은 실제 영상에서 해당 장면을 찾아 타임코드를 확정하십시오.",
        "비판/논쟁 댓글 사용 시 선수 및 채널 브랜드를 고려하십시오.",
    ],
}
