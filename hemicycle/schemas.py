"""Schemas of the stored tables and request records, and the enumerations stored as integers."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampNTZType

# Stored codes and names of the enumerations.
PROPOSAL_RESULTS = {0: "RejectedInGenerality", 1: "RejectedInSpeciality", 2: "ApprovedInGenerality", 3: "ApprovedInSpeciality"}
ORIENTATIONS = {0: "InFavor", 1: "Against", 2: "Abstaining", 3: "NotInterested"}


def _struct(**fields) -> StructType:
    """Field names to types; a type in a tuple is required."""
    return StructType([StructField(n, t[0] if isinstance(t, tuple) else t, not isinstance(t, tuple)) for n, t in fields.items()])


_I, _S, _B, _D = IntegerType(), StringType(), BooleanType(), DoubleType()

PARTIES = _struct(partyAcronym=(_S,), fullName=(_S,), logoLink=(_S,))
PROPOSALS = _struct(
    Id=(_I,), SourceId=(_I,), Legislatura=(_S,), Score=(_I,), amountOfUsersInterested=(_I,), totalAmountOfVotesFromUsers=(_I,), VoteDate=(_S,), ProposingPartypartyAcronym=(_S,),
    ProposalTitle=(_S,), FullProposalTextLink=(_S,), ProposalTextHTML=_S, ProposalResult=_I, VotingResultGeneralityId=_I, VotingResultSpecialityId=_I,
)
VOTING_RESULTS = _struct(Id=(_I,), isUninamous=(_B,))
VOTING_BLOCKS = _struct(Id=(_I,), VotingResultId=_I, isUninamousWithinParty=_B, numberOfDeputies=_I, politicalPartyAcronym=(_S,), votingOrientation=(_I,))
USERS = _struct(Id=(_I,), UserName=(_S,), Email=(_S,), Password=(_S,), ProfilePic=(_I,), googleIDToken=_S, facebookIDToken=_S)
VOTES = _struct(Id=(_I,), VoteDate=(TimestampNTZType(),), ProjectLawID=(_I,), VotingOrientation=(_I,), UserId=_I)
PARTY_STATS = _struct(Id=(_I,), PoliticalPartypartyAcronym=(_S,), PartyAffectionScore=(_D,), totalAmountOfProposalsVotedOn=(_I,), totalAffectionPoints=(_D,), UserId=_I)
TABLES = {"parties": PARTIES, "proposals": PROPOSALS, "voting_results": VOTING_RESULTS, "voting_blocks": VOTING_BLOCKS, "users": USERS, "votes": VOTES, "party_stats": PARTY_STATS}

CRITERIA = _struct(userID=(_I,), legislatura=ArrayType(_S), oldestVoteDate=_S, newestVoteDate=_S, lowestScoreAllowed=(_I,))
VOTE_REQUEST = _struct(userID=(_I,), projectLawID=(_I,), votingOrientation=(_S,))
_BLOCK_REQUEST = _struct(isUninamousWithinParty=_B, numberOfDeputies=_I, politicalPartyAcronym=_S, votingOrientation=_S)
_RESULT_REQUEST = _struct(isUninamous=_B, votingBlocks=ArrayType(_BLOCK_REQUEST))
PROPOSAL_REQUEST = _struct(
    legislatura=_S, sourceId=_I, score=_I, voteDate=_S, proposingPartyAcronym=_S, proposalTitle=_S, fullProposalTextLink=_S, proposalTextHTML=_S, proposalResult=_S,
    votingResultGenerality=_RESULT_REQUEST, votingResultSpeciality=_RESULT_REQUEST,
)
