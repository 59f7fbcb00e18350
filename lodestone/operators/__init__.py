"""Search, hierarchy and entity resolution as DataFrame operators."""
