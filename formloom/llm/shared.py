"""The shared-folder tables of the library, under the name that these operators use."""

from formloom.plans.store import shared_dir, written

__all__ = ["shared_dir", "written"]
