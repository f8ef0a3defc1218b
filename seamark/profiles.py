"""Preparation and embedding profiles: small immutable settings, chosen by id."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TextPreparation:
    strategy: str = "fixed"  # "fixed" or "structure"
    max_chars: int = 1600
    overlap_chars: int = 200
    min_chars: int | None = None
    contextual_title: bool = False

    @property
    def tail_chars(self) -> int:
        return self.max_chars // 4 if self.min_chars is None else self.min_chars


@dataclass(frozen=True)
class PagePreparation:
    text_min_chars: int = 20
    ocr: bool = False


@dataclass(frozen=True)
class MediaPreparation:
    segment_seconds: float = 30.0
    overlap_seconds: float = 0.0
    transcript_chars: int | None = None  # None: no transcript passages


@dataclass(frozen=True)
class Profile:
    profile_id: str
    model: str = "embedding-model"
    revision: str = "r1"
    dtype: str = "float32"
    dims: int = 768
    query_prompt: str = "task: search result | query: "
    document_template: str = "title: {title} | text: {content}"
    text: TextPreparation = TextPreparation()
    pages: PagePreparation = PagePreparation()
    audio: MediaPreparation = MediaPreparation()
    video: MediaPreparation = MediaPreparation()
    soundtrack: MediaPreparation | None = None  # None: the sound of a video is not segmented
    max_tokens: int = 8192
    embedded_metadata_fields: tuple[str, ...] = field(default=())


# The four published preparation settings.
_STRUCTURED = TextPreparation("structure", 1200, 200, 250, True)
PROFILES = {
    "p1": Profile("p1"),
    "p2": Profile("p2", text=TextPreparation("fixed", 800, 100)),
    "p3": Profile("p3", text=_STRUCTURED, audio=MediaPreparation(30.0, 5.0), video=MediaPreparation(30.0, 5.0)),
    "p4": Profile("p4", text=_STRUCTURED, pages=PagePreparation(20, True), audio=MediaPreparation(30.0, 5.0, 600),
                  video=MediaPreparation(20.0, 4.0, 600), soundtrack=MediaPreparation(30.0, 5.0)),
}
