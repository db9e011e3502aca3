"""Whether a run starts anew, resumes, or has nothing to do."""

from __future__ import annotations


class StartError(ValueError):
    pass


def policy(resume: bool, fresh: bool) -> str:
    if resume and fresh:
        raise StartError("resume and fresh exclude each other")
    return "resume" if resume else "fresh" if fresh else "auto"


def resolve(policy: str, incomplete: bool, finished: bool) -> str:
    """'fresh', 'resume' or 'done' for a policy, saved incomplete work and a finished product."""
    if policy == "fresh":
        return "fresh"
    if incomplete:
        return "resume"
    if policy == "resume":
        raise StartError("there is no incomplete work to resume")
    return "done" if finished else "fresh"
