"""strandwise: error-profile-aware correction of DNA sequencing reads on Spark."""
