"""Review analytics for places, as lazy DataFrame plans over many places at once."""
