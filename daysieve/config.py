"""Settings of a day, with bounds; what a user may set beyond them is moved to the nearest bound."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

#: Bounds of numbers.
BOUNDS = {"cutoff_hour": (0, 23), "gap_minutes": (5, 1440), "web_gap_minutes": (5, 1440), "burst_files": (2, 1000), "max_tokens": (200, 32_000), "scan_depth": (1, 20), "most_files": (1, 1_000_000)}


@dataclass(frozen=True)
class Config:
    zone: str = "UTC"
    cutoff_hour: int = 4
    gap_minutes: int = 90
    web_gap_minutes: int = 30
    burst_files: int = 8
    max_tokens: int = 4000
    scan_depth: int = 6
    most_files: int = 5000
    replies: bool = True
    outlines: bool = True
    browser: bool = False
    shell: bool = False
    vision: bool = False
    exclude_projects: tuple[str, ...] = ()
    exclude_domains: tuple[str, ...] = ()
    extra_extensions: tuple[str, ...] = ()

    def merged(self, more: dict[str, Any]) -> Config:
        """With the known settings of more; numbers within their bounds, values of another type and unknown names ignored."""
        known = {f.name: f for f in fields(self)}
        found = {}
        for k, v in more.items():
            default = getattr(self, k, None) if k in known else None
            if k not in known or v is None:
                continue
            if isinstance(default, bool):
                if isinstance(v, bool):
                    found[k] = v
            elif isinstance(default, int):
                if isinstance(v, (int, float)) and not isinstance(v, bool):
                    low, high = BOUNDS[k]
                    found[k] = int(min(max(v, low), high))
            elif isinstance(default, tuple):
                if isinstance(v, (list, tuple)):
                    found[k] = tuple(str(x).strip() for x in v if str(x).strip())
            elif isinstance(v, str) and v.strip():
                found[k] = v.strip()
        return replace(self, **found)

    def disclosure(self) -> tuple[list[str], list[str]]:
        """What a model would be shown with these settings, and what never."""
        # The wording shown to users.
        shown = ["你自己写的手记与各段的补充说明", *["AI 工具每轮最终回复的前 300 字"] * self.replies, "你的提问原文", "提交信息", "被改文件的文件名", "clone 的仓库名与远程地址", "AI 工具执行的命令与搜索的一句话描述"]
        shown += ["文档大纲（标题层级、工作表名、幻灯片标题）"] * self.outlines + ["浏览过的网页标题、域名、搜索词与停留时长"] * self.browser
        shown += ["你在终端敲的命令（不含输出，带凭据的已剔除）"] * self.shell + ["你在手记和补充说明里传的图片（原图）"] * self.vision
        return shown, ["文件正文", "diff", "完整路径", "网址参数", "命令输出", "助手的中间过程与工具输出"]
