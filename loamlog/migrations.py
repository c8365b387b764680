"""Schema versions and the steps between them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Migration:
    version: int
    name: str
    apply: Callable[[object], None]


@dataclass
class Registry:
    """Migrations in order of version, each known once."""

    known: dict[int, Migration] = field(default_factory=dict)

    def register(self, version: int, name: str, apply: Callable[[object], None]) -> None:
        if version in self.known:
            raise ValueError(f"version {version} is registered")
        self.known[version] = Migration(version, name, apply)

    def listed(self) -> list[Migration]:
        return [self.known[v] for v in sorted(self.known)]

    def pending(self, current: int) -> list[Migration]:
        return [m for m in self.listed() if m.version > current]

    def validate(self) -> None:
        """Versions must be 1, 2, 3, ..."""
        if sorted(self.known) != list(range(1, len(self.known) + 1)):
            raise ValueError("versions must follow each other from 1")

    def run(self, store) -> list[int]:
        """Applies what is pending, in order; the first failure ends it, and what came before stays."""
        self.validate()
        done = []
        for m in self.pending(store.schema_version):
            m.apply(store)
            store.set_schema_version(m.version)
            done.append(m.version)
        return done
